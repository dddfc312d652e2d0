"""Connected regions of masks of any size: labelled tile by tile, joined over the tiles' borders, measured by aggregation.

No task holds more than a tile. A tile's regions have numbers of their own; pixels on both sides of a border link two of them, and the
links' components are the regions of the image.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .lineage import stored
from .masks import PIXEL, label_regions

SIZE = 256
#: Numbers of a tile's regions, and tiles of a row and of a column of an image, stay below these powers of two.
REGION_BITS, TILE_BITS = 20, 14


def _labelled(mask: DataFrame, level: int, diagonal: bool, size: int) -> DataFrame:
    """(camera_id, y, x, mask, region long): `mask` with the number of its tile's region where it is `level`, else null."""
    import pyarrow as pa

    def run(t):
        y, x, m = (t[c].to_numpy() for c in ("y", "x", "mask"))
        ty, tx = int(y[0]) // size, int(x[0]) // size
        if ty >> TILE_BITS or tx >> TILE_BITS:
            raise ValueError("an image of too many tiles")
        a = np.zeros((size, size), bool)
        a[y - ty * size, x - tx * size] = m == level
        found = label_regions(a, diagonal=diagonal)[y - ty * size, x - tx * size].astype(np.int64)
        number = ((ty << TILE_BITS) + tx << REGION_BITS) + found
        return pa.table({"camera_id": t["camera_id"], "y": t["y"], "x": t["x"], "mask": t["mask"], "region": pa.array(number, mask=found == 0)})

    kinds = {c: mask.schema[c].dataType.simpleString() for c in (*PIXEL, "mask")}
    rows = mask.select(*PIXEL, "mask", F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx"))
    return rows.groupBy("camera_id", "ty", "tx").applyInArrow(lambda t: run(t), ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", region long")


def label(mask: DataFrame, level: int = 255, diagonal: bool = True, size: int = SIZE) -> DataFrame:
    """(camera_id, y, x, mask, region long): as `mask`, with the region of each pixel that is `level`, null elsewhere.

    Pixels of a region are joined by sides or, with `diagonal`, by corners. A region's number tells it apart within its camera. Pixels
    that are missing belong to no region; an empty mask has none. Rows and columns count from 0.
    """
    found = stored(_labelled(mask, level, diagonal, size))
    held = found.where("region is not null")
    border = held.where((F.col("y") % size == 0) | (F.col("y") % size == size - 1) | (F.col("x") % size == 0) | (F.col("x") % size == size - 1))
    border = border.select("camera_id", "y", "x", "region")
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps])).alias("s")
    moved = border.select("camera_id", "y", "x", "region", step).select("camera_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("region").alias("other"))
    pairs = border.join(moved, ["camera_id", "y", "x"]).where("region <> other").select("camera_id", "region", "other").distinct()
    # A region's number is its camera's only: nodes are hashes of both.
    node = lambda c: F.xxhash64("camera_id", c)
    ids = stored(pairs.select("camera_id", "region").union(pairs.select("camera_id", "other")).distinct().withColumn("id", node("region")))
    roots = connected_components(pairs.select(node("region").alias("u"), node("other").alias("v"))).join(ids, F.col("node") == F.col("id")).select("camera_id", "region", "root")
    own = roots.groupBy("camera_id", "root").agg(F.min("region").alias("first"))
    joined = roots.join(own, ["camera_id", "root"]).select("camera_id", "region", "first")
    return found.join(joined, ["camera_id", "region"], "left").select(*PIXEL, "mask", F.coalesce("first", "region").alias("region"))


def _shape(mask: DataFrame) -> DataFrame:
    return mask.groupBy("camera_id").agg(F.max("y").alias("__h"), F.max("x").alias("__w"))


def areas(labelled: DataFrame) -> DataFrame:
    """(camera_id, region, area, on_border): how many pixels each region of `label` has, and whether it touches the image's border."""
    at_edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("__h")) | (F.col("x") == F.col("__w"))
    held = labelled.join(_shape(labelled), "camera_id").where("region is not null")
    return held.groupBy("camera_id", "region").agg(F.count("*").alias("area"), F.max(at_edge).alias("on_border"))


def fill_holes(mask: DataFrame, size: int = SIZE) -> DataFrame:
    """(camera_id, y, x, mask): background that can't reach the border by sides becomes mask."""
    found = stored(label(mask, 0, False, size))
    inner = areas(found).where(~F.col("on_border")).select("camera_id", "region", F.lit(True).alias("__inner"))
    return found.join(inner, ["camera_id", "region"], "left").select(*PIXEL, F.when(F.col("__inner"), 255).otherwise(F.col("mask")).alias("mask"))


def remove_small(mask: DataFrame, min_area: int = 1000, size: int = SIZE) -> DataFrame:
    """(camera_id, y, x, mask): regions, joined by sides or corners, of fewer than `min_area` pixels go."""
    found = stored(label(mask, 255, True, size))
    large = areas(found).where(F.col("area") >= min_area).select("camera_id", "region", F.lit(True).alias("__large"))
    return found.join(large, ["camera_id", "region"], "left").select(*PIXEL, F.when(F.col("__large"), 255).otherwise(0).alias("mask"))
