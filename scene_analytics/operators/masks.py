"""Masks (camera_id, y, x, mask 0 or 255): regions, refinement, union, hints, overlays, composition."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, temporal, vignetting
from .lineage import materialize

PIXEL = ["camera_id", "y", "x"]


@dataclass(frozen=True)
class RefineConfig:
    kernel_size: int = 5
    iterations: int = 2
    fill_holes: bool = True
    smooth: bool = True
    min_area: int = 1000
    sigma: float = 3.0


def label_regions(a: np.ndarray, diagonal: bool) -> np.ndarray:
    """Numbers of connected true regions from 1, 0 elsewhere: runs of each row are joined with touching ones of the row above."""
    h, w = a.shape
    edge = np.diff(np.pad(a.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    root = np.arange(len(starts))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        above, here = int(first[y]), int(first[y + 1])
        while i < above and j < here:
            if starts[i] < ends[j] + reach and starts[j] < ends[i] + reach:
                a_, b_ = find(i), find(j)
                if a_ != b_:
                    root[max(a_, b_)] = min(a_, b_)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    labels = np.zeros((h, w), np.int64)
    for k in range(len(starts)):
        labels[rows[k], starts[k] : ends[k]] = find(k) + 1
    return labels


def fill_holes_array(a: np.ndarray) -> np.ndarray:
    """Background that can't reach the border by sides becomes mask."""
    labels = label_regions(a == 0, diagonal=False)
    border = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    return np.where((labels > 0) & ~np.isin(labels, border), 255, a)


def remove_small_array(a: np.ndarray, min_area: int) -> np.ndarray:
    """Regions, joined by sides or corners, of fewer than `min_area` pixels go."""
    labels = label_regions(a == 255, diagonal=True)
    area = np.bincount(labels.ravel())
    return np.where((labels > 0) & (area[labels] >= min_area), 255, 0)


def fill_holes(mask: DataFrame) -> DataFrame:
    return filters.on_maps(mask, "mask", fill_holes_array)


def remove_small_regions(mask: DataFrame, min_area: int = 1000) -> DataFrame:
    return filters.on_maps(mask, "mask", lambda a: remove_small_array(a, min_area))


def refine_array(a: np.ndarray, cfg: RefineConfig) -> np.ndarray:
    a = filters.morphology_array(a, "close", cfg.kernel_size, cfg.iterations)
    a = filters.morphology_array(a, "open", cfg.kernel_size, cfg.iterations)
    if cfg.fill_holes:
        a = fill_holes_array(a)
    a = remove_small_array(a, cfg.min_area)
    return filters.smooth_boundary_array(a, cfg.sigma) if cfg.smooth else a


def refine(mask: DataFrame, cfg: RefineConfig = RefineConfig()) -> DataFrame:
    """Close, open, fill holes, drop small regions, smooth: all in one group for each camera, so the map is shuffled once."""
    return filters.on_maps(mask, "mask", lambda a: refine_array(a, cfg))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select(*PIXEL, "mask").unionByName(b.select(*PIXEL, "mask"))
    return both.groupBy(*PIXEL).agg(F.max("mask").alias("mask"))


def apply_roi_hints(mask: DataFrame, confidence: DataFrame, regions: DataFrame, least: float = 0.3) -> DataFrame:
    """Adds pixels whose confidence is over `least` inside a region (camera_id, x, y, width, height), ends exclusive."""
    rois = regions.select("camera_id", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("width").alias("rw"), F.col("height").alias("rh"))
    # Regions are a handful for each camera: they travel as one list in the camera's row.
    lists = rois.groupBy("camera_id").agg(F.collect_list(F.struct("rx", "ry", "rw", "rh")).alias("rois"))
    inside = F.exists(F.coalesce("rois", F.array().cast("array<struct<rx:int,ry:int,rw:int,rh:int>>")), lambda r: (F.col("x") >= r["rx"]) & (F.col("x") < r["rx"] + r["rw"]) & (F.col("y") >= r["ry"]) & (F.col("y") < r["ry"] + r["rh"]))
    joined = mask.join(confidence.select(*PIXEL, "confidence"), PIXEL).join(lists, "camera_id", "left")
    return joined.select(*PIXEL, F.when(inside & (F.col("confidence") > least), 255).otherwise(F.col("mask")).alias("mask"))


def apply_mask(pixels: DataFrame, mask: DataFrame, fill: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Pixels under the mask (over 127) get the fill colour, blue first."""
    on = F.col("mask") > 127
    return pixels.join(mask.select(*PIXEL, "mask"), PIXEL).select(*pixels.columns[: pixels.columns.index("b")], *[F.when(on, v).otherwise(F.col(c)).cast("int").alias(c) for c, v in zip("bgr", fill, strict=True)])


def overlay(pixels: DataFrame, mask: DataFrame, color: tuple[int, int, int] = (0, 0, 255), alpha: float = 0.5, shown: bool = True) -> DataFrame:
    """Blends the colour, blue first, over pixels under the mask and truncates; nothing changes where it isn't shown."""
    on = (F.col("mask") > 127) & F.lit(shown)
    blend = lambda c, v: F.when(on, F.floor(v * alpha + F.col(c) * (1 - alpha))).otherwise(F.col(c)).cast("int").alias(c)
    return pixels.join(mask.select(*PIXEL, "mask"), PIXEL).select(*pixels.columns[: pixels.columns.index("b")], *[blend(c, v) for c, v in zip("bgr", color, strict=True)])


#: Overlay colours by name, blue first.
COLORS = {"red": (0, 0, 255), "green": (0, 255, 0), "blue": (255, 0, 0), "yellow": (0, 255, 255), "magenta": (255, 0, 255)}


def resize_mask(mask: DataFrame, shape: DataFrame) -> DataFrame:
    """The mask brought to the sizes shape(camera_id, h, w), bilinear."""
    scaled = filters.resize_to(mask.select(*PIXEL, F.col("mask").cast("double").alias("v")), shape, ["camera_id"])
    return scaled.select(*PIXEL, F.floor(F.col("v") + 0.5).cast("int").alias("mask"))


def export_levels(df: DataFrame, column: str) -> DataFrame:
    """0..1 as whole levels 0..255, truncated."""
    return df.withColumn(column, F.floor(F.col(column) * 255).cast("int"))


def generate(pixels: DataFrame, cameras: DataFrame | None = None, include_vignetting: bool = True, cfg: temporal.TemporalConfig = temporal.TemporalConfig(), refine_cfg: RefineConfig = RefineConfig(), vignetting_cfg: vignetting.VignettingConfig = vignetting.VignettingConfig()) -> dict[str, DataFrame]:
    """`generate_from` the analysis of pixel rows; `tiles.analyze` is the one of whole recordings."""
    return generate_from(materialize(temporal.analyze(pixels, cfg)), cameras, include_vignetting, refine_cfg, vignetting_cfg)


def generate_from(found: DataFrame, cameras: DataFrame | None = None, include_vignetting: bool = True, refine_cfg: RefineConfig = RefineConfig(), vignetting_cfg: vignetting.VignettingConfig = vignetting.VignettingConfig()) -> dict[str, DataFrame]:
    """final, static, vignetting and confidence maps of every camera, all cameras at once.

    `found` (camera_id, y, x, brightness, mask, confidence) has a row for each pixel of an image and is read several times, so it
    should be materialised. `cameras` (camera_id, has_vignetting, regions) may be missing: then there are no hints, and vignetting is
    as asked. A camera that has vignetting gets it in any case.
    """
    static = refine(found.select(*PIXEL, "mask"), refine_cfg)
    confidence = found.select(*PIXEL, "confidence")
    wanted = found.select(*PIXEL, "brightness")
    if cameras is None:
        wanted = wanted if include_vignetting else wanted.limit(0)
    elif not include_vignetting:
        flags = cameras.where("has_vignetting").select("camera_id")
        wanted = wanted.join(F.broadcast(flags), "camera_id", "left_semi")
    vignette, _ = vignetting.detect_on(wanted, vignetting_cfg)
    merged = union(static, vignette)
    if cameras is not None:
        regions = cameras.select("camera_id", F.explode("regions").alias("r")).select("camera_id", "r.x", "r.y", "r.width", "r.height")
        merged = apply_roi_hints(merged, confidence, regions)
    return {"final": refine(merged, refine_cfg), "static": static, "vignetting": vignette, "confidence": confidence}
