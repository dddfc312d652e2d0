"""Which frames to look at: index rules, samplers, iterators, and folders of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform_indices(spark: SparkSession, n: int, num: int, start_ratio: float = 0.0, end_ratio: float = 1.0) -> DataFrame:
    """(i, frame_idx): `num` indices (fewer if the range is shorter), truncated from float steps; none for an empty range."""
    lo, hi = int(n * start_ratio), int(n * end_ratio)
    k = min(num, hi - lo)
    if k <= 0:
        return spark.createDataFrame([], "i long, frame_idx long")
    return spark.range(k).select(F.col("id").alias("i"), F.floor(F.lit(float(lo)) + F.col("id") * F.lit((hi - lo) / k)).cast("long").alias("frame_idx"))


def uniform_frames(videos: DataFrame, num: int, start_ratio: float = 0.0, end_ratio: float = 1.0) -> DataFrame:
    """Adds i and frame_idx (long) to each row with its own frame_count: `uniform_indices` of all videos in one plan."""
    count = F.col("frame_count").cast("double")
    lo, hi = F.floor(count * start_ratio), F.floor(count * end_ratio)
    k = F.least(F.lit(num).cast("long"), hi - lo)
    steps = videos.withColumns({"__lo": lo, "__hi": hi, "__k": k}).where("__k > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    return steps.withColumn("frame_idx", F.floor(F.col("__lo") + F.col("i") * ((F.col("__hi") - F.col("__lo")) / F.col("__k"))).cast("long")).drop("__lo", "__hi", "__k")


def clip_indices(videos: DataFrame, count: int = 16) -> DataFrame:
    """Adds i and frame_idx: `count` indices from the first to the last frame of each row's frame_count; short clips repeat some."""
    i = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    steps = videos.where("frame_count > 0").withColumn("i", i)
    last = F.col("frame_count") - 1
    return steps.withColumn("frame_idx", last.cast("long") if count == 1 else F.floor(F.col("i") * last / F.lit(count - 1)).cast("long"))


def sample_frames(frames: DataFrame, num: int, start_ratio: float = 0.0, end_ratio: float = 1.0, n: int | None = None) -> DataFrame:
    """Rows of `frames` (one camera, frame_idx from 0) at the uniform indices; missing frames are skipped without a word."""
    n = frames.agg(F.coalesce(F.max("frame_idx") + 1, F.lit(0))).first()[0] if n is None else n
    return frames.join(F.broadcast(uniform_indices(frames.sparkSession, n, num, start_ratio, end_ratio).select("frame_idx").distinct()), "frame_idx")


def random_frames(frames: DataFrame, count: int, seed: int, clip: str = "clip") -> DataFrame:
    """`count` rows of each clip without replacement, by a seeded draw, in order of frame_idx within a clip."""
    draw = F.row_number().over(W.partitionBy(clip).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(clip), F.col("frame_idx"))), "frame_idx"))
    return frames.withColumn("__draw", draw).where(F.col("__draw") <= count).drop("__draw").orderBy(clip, "frame_idx")


def pad_frames(frames: DataFrame, count: int, clip: str = "clip") -> DataFrame:
    """Each clip's distinct sampled rows, then its last one again until there are `count`; adds slot from 0."""
    order = F.row_number().over(W.partitionBy(clip).orderBy("frame_idx")) - 1
    slots = frames.dropDuplicates([clip, "frame_idx"]).withColumn("slot", order).where(F.col("slot") < count)
    slots = slots.withColumn("__last", F.max("slot").over(W.partitionBy(clip)))
    fill = F.when(F.col("slot") == F.col("__last"), F.sequence(F.col("slot"), F.lit(count - 1))).otherwise(F.array(F.col("slot").cast("int")))
    return slots.withColumn("slot", F.explode(fill)).drop("__last")


def strided(frames: DataFrame, step: int = 1, stop_at_failure: bool = True, failed: str = "failed", video: str = "camera_id") -> DataFrame:
    """Every `step`-th frame. A video ends at its first undecodable frame; an image sequence skips unreadable ones.

    Videos are told apart by the column `video`; without it all rows are one. Rows whose video is null are one, too.
    """
    taken = frames.where(F.col("frame_idx") % step == 0)
    if failed not in frames.columns:
        return taken
    if not stop_at_failure:
        return taken.where(~F.col(failed))
    own = F.col(video) if video in frames.columns else F.lit(0)
    first = taken.where(F.col(failed)).groupBy(own.alias("__video")).agg(F.min("frame_idx").alias("__first"))
    return taken.join(first, own.eqNullSafe(F.col("__video")), "left").where("__first is null or frame_idx < __first").drop("__video", "__first")


def frame_at(frames: DataFrame, index: int) -> DataFrame:
    """The frame with that index; no row if there is none."""
    return frames.where(F.col("frame_idx") == index)


def clamp_index(index: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(index, n - 1))
