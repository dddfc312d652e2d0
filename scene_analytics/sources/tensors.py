"""Frames as model input: shortest side resized, middle cropped, levels scaled and normalised, channels first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tiles

SIZE = 224
#: Means and standard deviations of red, green and blue that common image models are trained with.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def _taps(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower place, upper place, share of the upper one) of each of `to` pixels among `n`; centres are matched, edges repeat."""
    at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), at - low


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """An image (height, width, channels) at another size, bilinear."""
    if a.shape[:2] == (h, w):
        return a.astype(float)
    y0, y1, fy = _taps(a.shape[0], h)
    x0, x1, fx = _taps(a.shape[1], w)
    a = a.astype(float)
    rows = a[y0] * (1 - fy)[:, None, None] + a[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def tensor(a: np.ndarray, size: int = SIZE, mean=MEAN, std=STD) -> np.ndarray:
    """(3, size, size), red first, of a blue-first image (height, width, 3)."""
    h, w = a.shape[:2]
    short = min(h, w)
    a = resized(a, max(size, round(h * size / short)), max(size, round(w * size / short)))
    y, x = (a.shape[0] - size) // 2, (a.shape[1] - size) // 2
    a = a[y : y + size, x : x + size, ::-1] / 255
    return ((a - np.array(mean)) / np.array(std)).transpose(2, 0, 1)


def prepare(frames: DataFrame, keys: list[str], size: int = SIZE, mean=MEAN, std=STD) -> DataFrame:
    """(`keys`, tensor array<float>: 3 * size * size numbers, channel by channel) of frames (height, width, n_channels, data).

    Grey fills all channels, a fourth one is left out. A frame is handled where it is; without data the tensor is null.
    """
    import pyarrow as pa

    from .frames import _image

    def run(batches):
        for r in tiles.rows(batches):
            made = None if r["data"] is None else tensor(_image(r), size, mean, std).astype(np.float32).ravel().tolist()
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k]], t) for k, t in zip(keys, kinds, strict=True)], pa.array([made], pa.list_(pa.float32()))], names=[*keys, "tensor"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(frames.schema[k].dataType) for k in keys]
    schema = ", ".join([f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys] + ["tensor array<float>"])
    return frames.select(*keys, "height", "width", "n_channels", "data").mapInArrow(run, schema)


def clips(tensors: DataFrame, size: int = SIZE, clip: str = "clip", slot: str = "slot") -> DataFrame:
    """(`clip`, frames int, tensor array<float>): the frames of each clip by slot as (3, frames, size, size); a clip is bounded by its sampler."""
    ordered = F.array_sort(F.collect_list(F.struct(slot, "tensor"))).alias("all")
    plane = size * size
    channel = lambda c: F.flatten(F.transform("all", lambda f: F.slice(f["tensor"], c * plane + 1, plane)))
    found = tensors.where("tensor is not null").groupBy(clip).agg(ordered)
    return found.select(clip, F.size("all").alias("frames"), F.concat(*[channel(c) for c in range(3)]).alias("tensor"))
