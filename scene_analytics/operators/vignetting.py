"""Vignetting on brightness maps (camera_id, y, x, brightness 0..1): radial profile, thresholds, edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import lightness
from . import filters
from .lineage import materialize

BINS = 100


@dataclass(frozen=True)
class VignettingConfig:
    brightness_threshold: float = 0.7
    min_brightness: float = 0.3
    use_radial_model: bool = True
    smooth_sigma: float = 5.0
    edge_margin: int = 100
    edge_threshold: float = 0.6


def brightness_map(pixels: DataFrame) -> DataFrame:
    light = lightness(F.col("b"), F.col("g"), F.col("r"))
    return pixels.groupBy("camera_id", "y", "x").agg((F.avg(light) / 255).alias("brightness"))


def _shape(df: DataFrame) -> DataFrame:
    return df.groupBy("camera_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def radial_distance(y: Column, x: Column, h: Column, w: Column) -> Column:
    """Distance from (h/2, w/2) as a share of the distance of the corner (0, 0)."""
    cy, cx = h / 2, w / 2
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / F.sqrt(cx * cx + cy * cy)


def with_distance(bright: DataFrame) -> DataFrame:
    return bright.join(F.broadcast(_shape(bright)), "camera_id").withColumn("d", radial_distance(F.col("y"), F.col("x"), F.col("h"), F.col("w")))


def radial_profile(bright: DataFrame, bins: int = BINS) -> DataFrame:
    """(camera_id, bin, radius, brightness): the mean of each ring, 0 for empty ones; the farthest corner is in none."""
    ring = F.floor(F.col("d") * bins).cast("int")
    rings = with_distance(bright).withColumn("bin", ring).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("camera_id", "bin").agg(F.avg("brightness").alias("mean"))
    all_bins = bright.select("camera_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return all_bins.join(rings, ["camera_id", "bin"], "left").select("camera_id", "bin", ((F.col("bin") + 0.5) / bins).alias("radius"), F.coalesce("mean", F.lit(0.0)).alias("brightness"))


def radial_radius(bright: DataFrame, threshold: float = 0.7, bins: int = BINS) -> DataFrame:
    """(camera_id, radius): the centre of the last ring that is bright enough against the brightest of the first ten."""
    profile = radial_profile(bright, bins)
    centre = profile.groupBy("camera_id").agg(F.max(F.when(F.col("bin") < 10, F.col("brightness"))).alias("centre"))
    enough = profile.join(centre, "camera_id").groupBy("camera_id").agg(F.max(F.when(F.col("brightness") >= F.col("centre") * threshold, F.col("radius"))).alias("radius"))
    return enough.select("camera_id", F.coalesce("radius", F.lit(0.5)).alias("radius"))


def radial_mask(bright: DataFrame, threshold: float = 0.7) -> DataFrame:
    radius = F.broadcast(radial_radius(bright, threshold))
    return with_distance(bright).join(radius, "camera_id").select("camera_id", "y", "x", F.when(F.col("d") > F.col("radius"), 255).otherwise(0).alias("mask"))


def _with_centre(bright: DataFrame) -> DataFrame:
    """Adds h, w and the mean of the middle ninth of the image."""
    sized = bright.join(F.broadcast(_shape(bright)), "camera_id")
    inside = (F.col("y") >= F.floor(F.col("h") / 3)) & (F.col("y") < F.floor(2 * F.col("h") / 3)) & (F.col("x") >= F.floor(F.col("w") / 3)) & (F.col("x") < F.floor(2 * F.col("w") / 3))
    centre = sized.groupBy("camera_id").agg(F.avg(F.when(inside, F.col("brightness"))).alias("centre"))
    return sized.join(F.broadcast(centre), "camera_id")


def threshold_mask(bright: DataFrame, threshold: float = 0.7, least: float = 0.3) -> DataFrame:
    dark = (F.col("brightness") < F.col("centre") * threshold) | (F.col("brightness") < least)
    return _with_centre(bright).select("camera_id", "y", "x", F.when(dark, 255).otherwise(0).alias("mask"))


def edge_mask(bright: DataFrame, margin: int = 100, threshold: float = 0.6, close: int = 11) -> DataFrame:
    """Dark pixels near a side, closed with a square."""
    near = (F.col("y") < margin) | (F.col("y") >= F.col("h") - margin) | (F.col("x") < margin) | (F.col("x") >= F.col("w") - margin)
    mask = _with_centre(bright).select("camera_id", "y", "x", F.when(near & (F.col("brightness") < F.col("centre") * threshold), 255).otherwise(0).alias("mask"))
    return filters.morphology(mask, "close", close, 1, "rect") if close else mask


def refine(mask: DataFrame, sigma: float = 5.0) -> DataFrame:
    """Closes, opens and smooths; one group for each camera."""

    def run(a):
        a = filters.morphology_array(filters.morphology_array(a, "close", 15), "open", 15)
        return filters.smooth_boundary_array(a, sigma) if sigma > 0 else a

    return filters.on_maps(mask, "mask", run)


def detect(pixels: DataFrame, cfg: VignettingConfig = VignettingConfig()) -> tuple[DataFrame, DataFrame]:
    """`detect_on` the pixels' brightness."""
    return detect_on(materialize(brightness_map(pixels)), cfg)  # a map for each camera, used several times


def detect_on(bright: DataFrame, cfg: VignettingConfig = VignettingConfig()) -> tuple[DataFrame, DataFrame]:
    """The refined mask, and (camera_id, radius): the radial model's, or 1 for the threshold model."""
    if cfg.use_radial_model:
        return refine(radial_mask(bright, cfg.brightness_threshold), cfg.smooth_sigma), radial_radius(bright, cfg.brightness_threshold)
    radius = bright.select("camera_id").distinct().withColumn("radius", F.lit(1.0))
    return refine(threshold_mask(bright, cfg.brightness_threshold, cfg.min_brightness), cfg.smooth_sigma), radius


def detect_edges(pixels: DataFrame, cfg: VignettingConfig = VignettingConfig()) -> DataFrame:
    return edge_mask(materialize(brightness_map(pixels)), cfg.edge_margin, cfg.edge_threshold)
