"""Mask editing as an append-only log: edits(mask_id, seq, op, x1, y1, x2, y2, size, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY = 50


def live_edits(log: DataFrame) -> DataFrame:
    """The brush and eraser strokes in force after all undo, redo and reset entries of `log`.

    Entries are taken by seq. An undo steps back, a redo forward again; a new stroke drops what was undone; at most the last
    HISTORY states are kept, and an undo or reset goes back no farther than the oldest of these. A mask's log is one row group.
    """
    import pyarrow as pa

    def run(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: r["seq"])
        done: list[dict] = []
        undone: list[dict] = []
        kept = 0  # strokes that can't be undone any more
        for r in rows:
            if r["op"] in ("brush", "eraser"):
                done.append(r)
                undone = []
                kept = max(kept, len(done) - (HISTORY - 1))
            elif r["op"] == "undo" and len(done) > kept:
                undone.append(done.pop())
            elif r["op"] == "redo" and undone:
                done.append(undone.pop())
            elif r["op"] == "reset":
                while len(done) > kept:
                    undone.append(done.pop())
        return pa.Table.from_pylist(done, schema=t.schema)

    return log.groupBy("mask_id").applyInArrow(run, log.schema)


def apply_edits(mask: DataFrame, strokes: DataFrame) -> DataFrame:
    """mask(mask_id, y, x, mask) with strokes drawn: pixels within half a stroke's size of its line take the last stroke's value.

    Each stroke is dealt into the pixels near its line, row by row, and of a pixel's strokes the last one is kept before they are
    shuffled: the work grows with what is drawn, however many strokes a mask has.
    """
    size = mask.groupBy("mask_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    ends = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    lines = strokes.select("mask_id", "seq", *ends, "size", F.floor(F.col("size") / 2).cast("double").alias("r"), F.when(F.col("op") == "brush", 255).otherwise(0).alias("v")).join(size, "mask_id")
    r = F.col("r")
    reach = F.abs(r)  # strokes of a negative size reach as far as those of its amount

    def places(low, high, most):
        first, last = F.greatest(F.ceil(low - 1e-6), F.lit(0)).cast("int"), F.least(F.floor(high + 1e-6), F.col(most)).cast("int")
        return F.when(first <= last, F.sequence(first, F.greatest(first, last)))

    rows = lines.withColumn("y", F.explode(places(F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach, "h")))
    # On a row only the part of the line that is within reach of it counts; along it x runs between the part's ends.
    slope = (F.col("x2") - F.col("x1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1"))
    near = lambda up: F.greatest(F.least(F.col("y") + (reach if up else -reach), F.greatest("y1", "y2")), F.least("y1", "y2"))
    at = [F.coalesce(F.col("x1") + slope * (near(up) - F.col("y1")), F.col(c)) for up, c in ((False, "x1"), (True, "x2"))]
    dots = rows.withColumn("x", F.explode(places(F.least(*at) - reach, F.greatest(*at) + reach, "w")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / F.when(length > 0, length)))).otherwise(F.lit(0.0))
    ex, ey = F.col("x") - (F.col("x1") + t * dx), F.col("y") - (F.col("y1") + t * dy)
    last = dots.where(ex * ex + ey * ey <= r * r).groupBy("mask_id", "y", "x").agg(F.max(F.struct("seq", "x1", "y1", "x2", "y2", "size", "v")).alias("last"))
    return mask.join(last, ["mask_id", "y", "x"], "left").select("mask_id", "y", "x", F.coalesce("last.v", F.col("mask")).cast("int").alias("mask"))


def cursor(log: DataFrame) -> DataFrame:
    """(mask_id, strokes, last_seq): how many strokes are in force and the last of them."""
    return live_edits(log).groupBy("mask_id").agg(F.count("*").alias("strokes"), F.max("seq").alias("last_seq"))


def latest(log: DataFrame, n: int = HISTORY) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("mask_id").orderBy(F.desc("seq")))
    return log.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def to_image(px: Column, py: Column, scale: Column, left: Column, top: Column) -> Column:
    """(x, y) of the image under a place on the screen, truncated; the image lies at (left, top), drawn at `scale`."""
    return F.struct(((px - left) / scale).cast("int").alias("x"), ((py - top) / scale).cast("int").alias("y"))
