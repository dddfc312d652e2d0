"""Frames as tiles, the layout for whole recordings: a row is a square part of a frame.

A 1080p frame is 40 rows instead of two million. Each task adds its tiles up to whole-number sums for each pixel, and only these sums
are shuffled: what moves grows with the size of an image and the number of tasks, not with the number of frames. The sums are those
of `temporal`, so both layouts give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import gray_array, lightness_array
from . import temporal
from .errors import AnalysisError
from .lineage import materialize

SIZE = 256
#: `data` holds h * w pixels of a blue, a green and a red byte, row by row; the first one is pixel (ty, tx) of a frame of height * width.
SCHEMA = "camera_id string, frame_idx int, ty int, tx int, h int, w int, height int, width int, data binary"
_SUMS = "camera_id string, ty int, tx int, h int, w int, height int, width int, n long, sums binary"
_KEY = ["camera_id", "ty", "tx", "h", "w", "height", "width"]
#: A task holds the sums of so many tiles at a time, about 200 MB, which is more than a frame of 3840 * 2160 has.
HELD = 160
#: So many squares of levels fit into a 32-bit sum.
ADDED = 1 << 15
#: Partial sums of a tile meet in so many groups first, so that no group grows with all tasks.
SPREAD = 32

#: The summed planes of each mode behind those of the channels and the lightness.
_MORE = {"lab": ["q"], "gray": ["s", "q"], "bgr": ["qb", "qg", "qr"]}


def cut(a: np.ndarray, size: int = SIZE) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(ty, tx, h, w, data) of an image (height, width, 3)."""
    for y in range(0, a.shape[0], size):
        for x in range(0, a.shape[1], size):
            part = a[y : y + size, x : x + size]
            yield y, x, part.shape[0], part.shape[1], part.tobytes()


def from_pixels(pixels: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of pixel rows (camera_id, frame_idx, y, x, b, g, r). Pixels that are missing count as black."""
    shape = pixels.groupBy("camera_id", "frame_idx").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    edge = F.lit(size)
    placed = pixels.join(shape, ["camera_id", "frame_idx"]).withColumns({"ty": F.col("y") - F.col("y") % edge, "tx": F.col("x") - F.col("x") % edge})

    def run(key, t):
        camera, frame, height, width, ty, tx = (k.as_py() for k in key)
        a = np.zeros((min(size, height - ty), min(size, width - tx), 3), np.uint8)
        a[t["y"].to_numpy() - ty, t["x"].to_numpy() - tx] = np.stack([t[c].to_numpy() for c in "bgr"], axis=1)
        return pa.table({"camera_id": [camera], "frame_idx": pa.array([frame], pa.int32()), **{c: pa.array([v], pa.int32()) for c, v in (("ty", ty), ("tx", tx), ("h", a.shape[0]), ("w", a.shape[1]), ("height", height), ("width", width))}, "data": pa.array([a.tobytes()], pa.binary())})

    whole = placed.select("camera_id", *[F.col(c).cast("int").alias(c) for c in ("frame_idx", "height", "width", "ty", "tx", "y", "x", "b", "g", "r")])
    return whole.groupBy("camera_id", "frame_idx", "height", "width", "ty", "tx").applyInArrow(run, SCHEMA)


def to_pixels(tiles: DataFrame) -> DataFrame:
    """Pixel rows of tiles."""

    def run(batches):
        for r in rows(batches):
            a = np.frombuffer(r["data"], np.uint8).reshape(-1, 3)
            y, x = np.divmod(np.arange(len(a)), r["w"])
            yield pa.RecordBatch.from_arrays([pa.array([r["camera_id"]] * len(a), pa.string()), *[pa.array(v, pa.int32()) for v in (np.full(len(a), r["frame_idx"]), y + r["ty"], x + r["tx"], a[:, 0], a[:, 1], a[:, 2])]], names=["camera_id", "frame_idx", "y", "x", "b", "g", "r"])

    return tiles.mapInArrow(run, "camera_id string, frame_idx int, y int, x int, b int, g int, r int")


def rows(batches) -> Iterator[dict]:
    """Rows of Arrow batches, one at a time: they hold images."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _planes(a: np.ndarray, mode: str) -> np.ndarray:
    b, g, r = a
    light = lightness_array(b, g, r)
    if mode == "lab":
        more = [light * light]
    elif mode == "gray":
        lead = gray_array(b, g, r)
        more = [lead, lead * lead]
    else:
        more = [c.astype(np.uint32) ** 2 for c in a]
    return np.stack([b, g, r, light, *more]).astype(np.uint32)


def sums(tiles: DataFrame, mode: str = "lab") -> DataFrame:
    """(camera_id, height, width, y, x, n, sb, sg, sr, sl and the mode's further sums), all whole numbers, for each pixel."""
    if mode not in _MORE:
        raise ValueError(f"unknown mode {mode}")
    planes = ["sb", "sg", "sr", "sl", *_MORE[mode]]

    def emit(key, n, total) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), *[pa.array([v], pa.int32()) for v in key[1:]], pa.array([n], pa.int64()), pa.array([total.astype(np.int64).tobytes()], pa.binary())], names=[*_KEY, "n", "sums"])

    def add_up(batches):
        held: dict[tuple, list] = {}
        for r in rows(batches):
            key = tuple(r[c] for c in _KEY)
            if key not in held and len(held) >= HELD:
                yield from (emit(k, *v) for k, v in held.items())
                held = {}
            kept = held.setdefault(key, [0, np.zeros((len(planes), r["h"] * r["w"]), np.uint32)])
            kept[0] += 1
            kept[1] += _planes(np.frombuffer(r["data"], np.uint8).reshape(-1, 3).T, mode)
            if kept[0] == ADDED:
                yield emit(key, *held.pop(key))
        yield from (emit(k, *v) for k, v in held.items())

    def total_of(batches) -> tuple[int, np.ndarray]:
        n, total = 0, 0
        for r in rows(batches):
            n += r["n"]
            total = total + np.frombuffer(r["sums"], np.int64).reshape(len(planes), -1)
        return n, total

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield emit(tuple(k.as_py() for k in key[: len(_KEY)]), *total_of(batches))

    def spread_out(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        camera, ty, tx, h, w, height, width = (k.as_py() for k in key)
        n, total = total_of(batches)
        y, x = np.divmod(np.arange(h * w), w)
        for at in range(0, h * w, 1 << 14):
            s = slice(at, at + (1 << 14))
            many = len(y[s])
            yield pa.RecordBatch.from_arrays([pa.array([camera] * many, pa.string()), *[pa.array(v, pa.int32()) for v in (np.full(many, height), np.full(many, width), y[s] + ty, x[s] + tx)], pa.array(np.full(many, n), pa.int64()), *[pa.array(p[s], pa.int64()) for p in total]], names=["camera_id", "height", "width", "y", "x", "n", *planes])

    part = tiles.select("camera_id", *[F.col(c).cast("int").alias(c) for c in _KEY[1:]], "data").mapInArrow(add_up, _SUMS)
    met = part.withColumn("some", F.spark_partition_id() % SPREAD).groupBy(*_KEY, "some").applyInArrow(meet, _SUMS)
    return met.groupBy(*_KEY).applyInArrow(spread_out, "camera_id string, height int, width int, y int, x int, n long, " + ", ".join(f"{p} long" for p in planes))


def _variance(mode: str):
    n = F.col("n")
    if mode == "bgr":
        return (temporal.spread(n, F.col("sb"), F.col("qb")) + temporal.spread(n, F.col("sg"), F.col("qg")) + temporal.spread(n, F.col("sr"), F.col("qr"))) / 3
    return temporal.spread(n, F.col("sl" if mode == "lab" else "s"), F.col("q"))


def variance(tiles: DataFrame, mode: str = "lab") -> DataFrame:
    """As `temporal.variance`."""
    return sums(tiles, mode).select(*temporal.PIXEL, _variance(mode).alias("variance"))


def analyze(tiles: DataFrame, cfg: temporal.TemporalConfig = temporal.TemporalConfig()) -> DataFrame:
    """As `temporal.analyze`, computed once and kept: no frames, or frames of one camera that differ in size, raise an error."""
    mode = "lab" if cfg.use_lab else "gray"
    found = materialize(sums(tiles, mode))
    worst = found.groupBy("camera_id").agg(F.countDistinct("height", "width").alias("n")).agg(F.max("n")).first()[0]
    if worst is None:
        raise AnalysisError("no frames")
    if worst > 1:
        raise AnalysisError("frames of a camera differ in size")
    means = [F.floor(F.col(f"s{c}") / F.col("n")).cast("int").alias(f"mean_{c}") for c in "bgr"]
    return temporal.decided(found.select(*temporal.PIXEL, _variance(mode).alias("variance"), *means, (F.col("sl") / F.col("n") / 255).alias("brightness")), cfg)
