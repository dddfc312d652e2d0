"""Variance over time and what follows from it, on pixels(camera_id, frame_idx, y, x, b, g, r)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import gray, lightness
from . import filters
from .errors import AnalysisError

PIXEL = ["camera_id", "y", "x"]


@dataclass(frozen=True)
class TemporalConfig:
    variance_threshold: float = 50.0
    use_lab: bool = True
    block_size: int = 64
    percentile: float = 10.0
    scales: tuple[float, ...] = (1.0, 0.5, 0.25)


def require_frames(pixels: DataFrame) -> DataFrame:
    """Raises where there is no frame or frames of one camera differ in size."""
    shapes = pixels.groupBy("camera_id", "frame_idx").agg(F.max("y").alias("h"), F.max("x").alias("w")).groupBy("camera_id").agg(F.countDistinct("h", "w").alias("n"))
    worst = shapes.agg(F.max("n")).first()[0]
    if worst is None:
        raise AnalysisError("no frames")
    if worst > 1:
        raise AnalysisError("frames of a camera differ in size")
    return pixels


def _variance(v: Column) -> Column:
    """Population variance of whole levels from exact sums."""
    v = v.cast("long")
    return spread(F.count(v), F.sum(v), F.sum(v * v))


def spread(n: Column, s: Column, q: Column) -> Column:
    """Population variance from the number, the sum and the sum of squares."""
    return (n * q - s * s) / (n * n)


def variance(pixels: DataFrame, mode: str = "lab") -> DataFrame:
    """(camera_id, y, x, variance) over all frames: of lightness ("lab"), of grey, or the mean of three channels ("bgr")."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    if mode == "bgr":
        v = (_variance(b) + _variance(g) + _variance(r)) / 3
    elif mode in ("lab", "gray"):
        v = _variance(lightness(b, g, r) if mode == "lab" else gray(b, g, r))
    else:
        raise ValueError(f"unknown mode {mode}")
    return pixels.groupBy(*PIXEL).agg(v.alias("variance"))


def mean_frame(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*PIXEL).agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in ("b", "g", "r")])


def static_mask(variances: DataFrame, threshold: float | Column = 50.0) -> DataFrame:
    """255 where the variance is under the threshold, else 0."""
    return variances.select(*PIXEL, F.when(F.col("variance") < threshold, 255).otherwise(0).alias("mask"))


def confidence_of(v: Column, threshold: float) -> Column:
    if threshold <= 0:
        raise ValueError("the threshold has to be positive")
    return 1 / (1 + F.exp((v - threshold) / (threshold / 3)))


def confidence(variances: DataFrame, threshold: float = 50.0) -> DataFrame:
    """One half at the threshold, towards 1 below."""
    return variances.select(*PIXEL, confidence_of(F.col("variance"), threshold).alias("confidence"))


def analyze(pixels: DataFrame, cfg: TemporalConfig = TemporalConfig()) -> DataFrame:
    """(camera_id, y, x, variance, mean channels, brightness, mask, confidence) in one aggregation."""
    require_frames(pixels)
    channels = [F.col(c) for c in "bgr"]
    lead = (lightness if cfg.use_lab else gray)(*channels)
    means = [F.floor(F.avg(c)).cast("int").alias(f"mean_{c}") for c in "bgr"]
    return decided(pixels.groupBy(*PIXEL).agg(_variance(lead).alias("variance"), *means, (F.avg(lightness(*channels)) / 255).alias("brightness")), cfg)


def decided(found: DataFrame, cfg: TemporalConfig = TemporalConfig()) -> DataFrame:
    """Adds mask and confidence to what has the variance."""
    t = cfg.variance_threshold
    return found.withColumns({"mask": F.when(F.col("variance") < t, 255).otherwise(0), "confidence": confidence_of(F.col("variance"), t)})


def block_thresholds(variances: DataFrame, cfg: TemporalConfig = TemporalConfig()) -> DataFrame:
    """(camera_id, by, bx, threshold): the base threshold or twice the block's low percentile, whichever is less."""
    size = F.lit(cfg.block_size)
    blocks = variances.groupBy("camera_id", F.floor(F.col("y") / size).cast("int").alias("by"), F.floor(F.col("x") / size).cast("int").alias("bx"))
    return blocks.agg(F.least(F.lit(cfg.variance_threshold), 2 * F.percentile("variance", cfg.percentile / 100)).alias("threshold"))


def adaptive_threshold(variances: DataFrame, cfg: TemporalConfig = TemporalConfig(), smooth: bool = True) -> DataFrame:
    """(camera_id, y, x, variance, threshold) by blocks, smoothed with a quarter of the block as sigma."""
    size = F.lit(cfg.block_size)
    keyed = variances.withColumns({"by": F.floor(F.col("y") / size).cast("int"), "bx": F.floor(F.col("x") / size).cast("int")})
    found = keyed.join(block_thresholds(variances, cfg), ["camera_id", "by", "bx"]).select(*PIXEL, "variance", "threshold")
    return filters.gaussian(found, "threshold", cfg.block_size / 4) if smooth else found


def adaptive_static_mask(variances: DataFrame, cfg: TemporalConfig = TemporalConfig()) -> DataFrame:
    found = adaptive_threshold(variances, cfg)
    return found.select(*PIXEL, F.when(F.col("variance") < F.col("threshold"), 255).otherwise(0).alias("mask"))


def multiscale(pixels: DataFrame, cfg: TemporalConfig = TemporalConfig()) -> DataFrame:
    """(camera_id, y, x, confidence, mask): mean confidence over scaled frames brought back to size; 255 above one half."""
    parts = None
    light = pixels.select("camera_id", "frame_idx", "y", "x", (lightness if cfg.use_lab else gray)(F.col("b"), F.col("g"), F.col("r")).cast("double").alias("v"))
    shape = pixels.groupBy("camera_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    for s in cfg.scales:
        part = light if s == 1.0 else filters.resize(light, s, ["camera_id", "frame_idx"], whole=True)
        conf = part.groupBy(*PIXEL).agg(confidence_of(F.var_pop("v"), cfg.variance_threshold).alias("v"))
        conf = conf if s == 1.0 else filters.resize_to(conf, shape, ["camera_id"])
        parts = conf if parts is None else parts.unionByName(conf)
    return parts.groupBy(*PIXEL).agg(F.avg("v").alias("confidence")).withColumn("mask", F.when(F.col("confidence") > 0.5, 255).otherwise(0))
