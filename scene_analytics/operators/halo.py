"""Neighbourhood filters of images of any size: each tile with a border of its neighbours' pixels is a group, and only the tile is kept.

The same functions of arrays as for whole maps run on the tiles. Where a tile ends at the image's edge so does its array, so edges are
treated alike; what an inner cut spoils lies within the border and is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, masks, regions, temporal
from .lineage import stored

SIZE = 256


def on_tiles(df: DataFrame, column: str, fn: Callable[[np.ndarray], np.ndarray], halo: int, size: int = SIZE, out: str | None = None, kind: str = "int") -> DataFrame:
    """(camera_id, y, x, out): as `filters.on_maps`, for functions whose result at a pixel depends on what lies within `halo` of it.

    A tile has `size` rows and columns at most; a pixel near a border travels to the tiles that it is near to. Missing pixels count as 0.
    """
    import pyarrow as pa

    name = out or column
    arrow = {"int": pa.int32(), "double": pa.float64()}[kind]
    near = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0)), F.floor((F.col(c) + halo) / size))
    rows = df.select(F.col("camera_id").cast("string").alias("camera_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(column).cast(kind).alias("v"))
    rows = rows.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))

    def run(key, t):
        ty, tx = (k.as_py() * size for k in key[1:])
        y, x, v = (t[c].to_numpy() for c in ("y", "x", "v"))
        top, left = int(y.min()), int(x.min())
        own = (y >= ty) & (y < ty + size) & (x >= tx) & (x < tx + size)
        y, x, own_y, own_x = y - top, x - left, y[own], x[own]
        b = np.empty(0)
        if own.any():
            a = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.float64 if kind == "double" else np.int32)
            a[y, x] = v
            b = fn(a)[y[own], x[own]]
        return pa.table({"camera_id": pa.repeat(key[0], len(b)).cast(pa.string()), "y": pa.array(own_y, pa.int32()), "x": pa.array(own_x, pa.int32()), name: pa.array(b.astype(arrow.to_pandas_dtype()), arrow)})

    return rows.groupBy("camera_id", "ty", "tx").applyInArrow(run, f"camera_id string, y int, x int, {name} {kind}")


def _reach(op: str, k: int, iterations: int) -> int:
    return (2 if op in ("close", "open") else 1) * iterations * (k // 2)


def morphology(mask: DataFrame, op: str, k: int = 5, iterations: int = 2, shape: str = "ellipse", size: int = SIZE) -> DataFrame:
    """As `filters.morphology`."""
    return on_tiles(mask, "mask", lambda a: filters.morphology_array(a, op, k, iterations, shape), _reach(op, k, iterations), size)


def gaussian(df: DataFrame, column: str, sigma: float, size: int = SIZE) -> DataFrame:
    """(camera_id, y, x, `column`), smoothed; edges reflect."""
    return on_tiles(df, column, lambda a: filters.gaussian_array(a, sigma), len(filters.gaussian_kernel(sigma)) // 2, size, kind="double")


def smooth_boundary(mask: DataFrame, sigma: float = 3.0, size: int = SIZE) -> DataFrame:
    """The mask's Gaussian over one half."""
    return on_tiles(mask, "mask", lambda a: filters.smooth_boundary_array(a, sigma), len(filters.gaussian_kernel(sigma)) // 2, size)


def refine(mask: DataFrame, cfg: masks.RefineConfig = masks.RefineConfig(), size: int = SIZE) -> DataFrame:
    """As `masks.refine`, with no group larger than a tile and its border."""
    k, n = cfg.kernel_size, cfg.iterations
    closed = on_tiles(mask, "mask", lambda a: filters.morphology_array(filters.morphology_array(a, "close", k, n), "open", k, n), 2 * _reach("close", k, n), size)
    filled = regions.fill_holes(closed, size) if cfg.fill_holes else closed
    kept = regions.remove_small(stored(filled), cfg.min_area, size)
    return smooth_boundary(kept, cfg.sigma, size) if cfg.smooth else kept


def block_thresholds_array(a: np.ndarray, cfg: temporal.TemporalConfig) -> np.ndarray:
    """For each pixel of a map of variances the base threshold or twice its block's low percentile, whichever is less."""
    out, n = np.empty(a.shape), cfg.block_size
    for y in range(0, a.shape[0], n):
        for x in range(0, a.shape[1], n):
            block = a[y : y + n, x : x + n]
            out[y : y + n, x : x + n] = min(cfg.variance_threshold, 2 * np.percentile(block, cfg.percentile))
    return out


def adaptive_static_mask(variances: DataFrame, cfg: temporal.TemporalConfig = temporal.TemporalConfig(), size: int = SIZE) -> DataFrame:
    """As `temporal.adaptive_static_mask`, without a join on pixels: a tile of whole blocks comes with the blocks that its smoothing reaches."""
    n = cfg.block_size
    reach = len(filters.gaussian_kernel(n / 4)) // 2
    halo, tile = -(-reach // n) * n, -(-size // n) * n  # whole blocks, so that an array's blocks are the image's

    def run(a):
        return np.where(a < filters.gaussian_array(block_thresholds_array(a, cfg), n / 4), 255.0, 0.0)

    found = on_tiles(variances, "variance", run, halo, tile, "mask", "double")
    return found.withColumn("mask", F.col("mask").cast("int"))
