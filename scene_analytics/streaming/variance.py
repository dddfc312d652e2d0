"""Variance over time of a stream of pixels: three exact sums for each pixel are all the state there is."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import temporal


def running_variance(pixels: DataFrame, mode: str = "lab") -> DataFrame:
    """The same plan as for tables; run it in complete or update mode."""
    return temporal.variance(pixels, mode)


def running_mask(pixels: DataFrame, threshold: float = 50.0, mode: str = "lab") -> DataFrame:
    return temporal.static_mask(running_variance(pixels, mode), threshold)


def stream_pixels(spark, folder: str, max_files: int = 1) -> DataFrame:
    """A stream of Parquet files of pixels, some files at a time."""
    from ..sources.frames import PIXELS

    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", max_files).parquet(folder)
