"""Which camera a file belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import stem


def wide(cameras: DataFrame) -> DataFrame:
    return cameras.where("type = 'wide'")


def narrow(cameras: DataFrame) -> DataFrame:
    return cameras.where("type = 'narrow'")


def match(videos: DataFrame, cameras: DataFrame) -> DataFrame:
    """(file_path, camera_id): the first camera by cfg_order whose id is in the file's stem; null without one.

    Cameras are a configuration file's: their ordered list rides along in each row.
    """
    ordered = cameras.agg(F.sort_array(F.collect_list(F.struct("cfg_order", "camera_id"))).alias("__all"))
    rows = videos.crossJoin(F.broadcast(ordered))
    fits = F.filter("__all", lambda c: F.contains(stem(F.col("file_path")), c["camera_id"]))
    return rows.select("file_path", F.get(fits, F.lit(0))["camera_id"].alias("camera_id"))


def with_fallback(matched: DataFrame, cameras: DataFrame) -> DataFrame:
    """Unmatched files take the first camera; without cameras they stay unmatched."""
    first = cameras.agg(F.min(F.struct("cfg_order", "camera_id")).alias("f")).select(F.col("f.camera_id").alias("first"))
    return matched.crossJoin(F.broadcast(first)).select("file_path", F.coalesce("camera_id", "first").alias("camera_id"))


def batch(videos: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Videos (camera_id, file_path) joined with their cameras, and those whose camera isn't configured."""
    return videos.join(cameras, "camera_id"), videos.join(cameras, "camera_id", "left_anti")


def vignetting_wanted(cameras: DataFrame, include: bool = True, keys: list[str] | None = None) -> DataFrame:
    """(`keys`, camera_id, wanted); `keys` tell configurations apart."""
    return cameras.select(*(keys or []), "camera_id", (F.col("has_vignetting") | F.lit(include)).alias("wanted"))
