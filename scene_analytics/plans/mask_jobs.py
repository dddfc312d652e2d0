"""Mask jobs: one source, or a batch of videos of many cameras in one plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks, sampling, temporal, tiles
from ..sources import frames as source
from ..sources import png


def settings(whole: DataFrame | None, variance_threshold: float | None = None, kernel_size: int | None = None) -> tuple[temporal.TemporalConfig, masks.RefineConfig]:
    """An override before the global setting before the default."""
    g = whole.first() if whole is not None else None
    t, r = temporal.TemporalConfig(), masks.RefineConfig()
    threshold = variance_threshold if variance_threshold is not None else g.variance_threshold if g else t.variance_threshold
    kernel = kernel_size if kernel_size is not None else g.morphology_kernel_size if g else r.kernel_size
    return replace(t, variance_threshold=float(threshold)), replace(r, kernel_size=int(kernel))


def settings_of(wholes: DataFrame, variance_threshold: float | None = None, kernel_size: int | None = None) -> DataFrame:
    """`settings` for many configurations at once: variance_threshold and kernel_size instead of the columns of global settings."""
    first = lambda over, c, default: F.coalesce(F.lit(over), F.col(c), F.lit(default))
    t = first(variance_threshold, "variance_threshold", temporal.TemporalConfig().variance_threshold).cast("double")
    k = first(kernel_size, "morphology_kernel_size", masks.RefineConfig().kernel_size).cast("int")
    return wholes.withColumns({"variance_threshold": t, "kernel_size": k}).drop("morphology_kernel_size")


def sample_count(whole: DataFrame | None, samples: int | None = None) -> int:
    return samples or (whole.first().frame_sample_count if whole is not None else 100)


def single(spark: SparkSession, frames: DataFrame, cameras: DataFrame | None = None, whole: DataFrame | None = None, samples: int | None = None, threshold: float | None = None, include_vignetting: bool = True, sampled: bool = False) -> dict[str, DataFrame]:
    """Masks of one camera's frames (camera_id, frame_idx, height, width, n_channels, data), by tiles; `sampled` frames are taken all."""
    t, r = settings(whole, threshold)
    found = tiles.analyze(source.to_tiles(frames if sampled else sampling.sample_frames(frames, sample_count(whole, samples))), t)
    return masks.generate_from(found, cameras, include_vignetting, r)


def save(found: dict[str, DataFrame], folder: str, intermediate: bool = False, name: str | None = None) -> None:
    """PNG files named by camera or, those of one source, by `name`."""
    if name is not None:
        found = {k: df.withColumn("camera_id", F.lit(name)) for k, df in found.items()}
    png.write_masks(found["final"], folder)
    if intermediate:
        png.write_masks(found["static"], folder, "static")
        png.write_masks(found["vignetting"], folder, "vignetting")
        png.write_masks(masks.export_levels(found["confidence"].withColumnRenamed("confidence", "mask"), "mask"), folder, "confidence")


def batch(pixels: DataFrame, cameras: DataFrame, whole: DataFrame | None = None, threshold: float | None = None, include_vignetting: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """Masks of all configured cameras of `pixels` in one plan, and the camera ids that aren't configured."""
    unknown = pixels.select("camera_id").distinct().join(cameras, "camera_id", "left_anti")
    known = pixels.join(F.broadcast(cameras.select("camera_id")), "camera_id", "left_semi")
    if known.limit(1).isEmpty():
        return {}, unknown
    t, r = settings(whole, threshold)
    return masks.generate(known, cameras, include_vignetting, t, r), unknown
