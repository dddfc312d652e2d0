"""Neighbourhood filters of whole maps keyed (camera_id, y, x): a camera's map is one Arrow group of bounded size (an image).

The same filters over arrays are plain functions, so that they can be composed inside one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ellipse(k: int) -> np.ndarray:
    """Half-width of each kernel row: what an ellipse of k by k covers."""
    r = k // 2
    return np.array([int(round(np.sqrt(max(r * r - d * d, 0)))) if r else 0 for d in range(-r, k - r)])


def kernel_offsets(k: int, shape: str = "ellipse") -> list[tuple[int, int]]:
    r = k // 2
    widths = ellipse(k) if shape == "ellipse" else np.full(k, r)
    return [(d - r, x) for d, w in enumerate(widths.tolist()) for x in range(-w, w + 1)]


def _morph(a: np.ndarray, k: int, shape: str, largest: bool) -> np.ndarray:
    """Maximum or minimum under the kernel; what lies outside the image is not looked at."""
    h, w = a.shape
    r = k // 2
    fill = 0 if largest else 255
    padded = np.full((h + 2 * r, w + 2 * r), fill, a.dtype)
    padded[r : r + h, r : r + w] = a
    out = np.full_like(a, fill)
    op = np.maximum if largest else np.minimum
    by_width: dict[int, np.ndarray] = {}
    widths = ellipse(k) if shape == "ellipse" else np.full(k, r)
    for d, half in enumerate(widths.tolist()):
        if half not in by_width:
            row = padded[:, r - half : r - half + w].copy()
            for x in range(1, 2 * half + 1):
                op(row, padded[:, r - half + x : r - half + x + w], out=row)
            by_width[half] = row
        op(out, by_width[half][d : d + h], out=out)
    return out


def morphology_array(a: np.ndarray, op: str, k: int = 5, iterations: int = 1, shape: str = "ellipse") -> np.ndarray:
    steps = {"dilate": "d", "erode": "e", "close": "de", "open": "ed"}.get(op, "")
    for s in steps:
        for _ in range(iterations):
            a = _morph(a, k, shape, s == "d")
    return a


def gaussian_kernel(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def gaussian_array(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable, rows then columns; edges reflect (the edge pixel counts twice)."""
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    for axis in (0, 1):
        n = a.shape[axis]
        at = np.arange(-r, n + r) % (2 * n)
        at = np.where(at >= n, 2 * n - 1 - at, at)
        padded = np.take(a, at, axis=axis)
        a = sum(w * np.take(padded, np.arange(i, i + n), axis=axis) for i, w in enumerate(kernel))
    return a


def on_maps(df: DataFrame, column: str, fn, out: str | None = None, kind: str = "int") -> DataFrame:
    """`fn` on each camera's whole map; (camera_id, y, x, out). Pixels that are missing count as 0."""
    import pyarrow as pa

    name = out or column
    arrow = {"int": pa.int32(), "double": pa.float64()}[kind]

    def run(key, t):
        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        v = t[column].to_numpy()
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.float64 if kind == "double" else np.int32)
        a[y, x] = v
        b = fn(a)
        return pa.table({"camera_id": pa.repeat(key[0], len(y)).cast(pa.string()), "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), name: pa.array(b[y, x].astype(arrow.to_pandas_dtype()), arrow)})

    kinds = df.select("camera_id", F.col("y").cast("int"), F.col("x").cast("int"), F.col(column).cast(kind))
    return kinds.groupBy("camera_id").applyInArrow(run, f"camera_id string, y int, x int, {name} {kind}")


def morphology(mask: DataFrame, op: str, k: int = 5, iterations: int = 2, shape: str = "ellipse") -> DataFrame:
    """dilate, erode, close or open, each step `iterations` times; another op leaves the mask as it is."""
    return on_maps(mask, "mask", lambda a: morphology_array(a, op, k, iterations, shape))


def gaussian(df: DataFrame, column: str, sigma: float) -> DataFrame:
    """Smooths `column`, other columns stay."""
    smooth = on_maps(df, column, lambda a: gaussian_array(a, sigma), "__smooth", "double")
    return df.join(smooth, ["camera_id", "y", "x"]).withColumn(column, F.col("__smooth")).drop("__smooth")


def smooth_boundary_array(a: np.ndarray, sigma: float) -> np.ndarray:
    return np.where(gaussian_array(a / 255.0, sigma) > 0.5, 255, 0)


def smooth_boundary(mask: DataFrame, sigma: float = 3.0) -> DataFrame:
    """The mask's Gaussian over one half."""
    return on_maps(mask, "mask", lambda a: smooth_boundary_array(a, sigma))


def morphology_window(mask: DataFrame, op: str, k: int = 5, shape: str = "ellipse") -> DataFrame:
    """dilate or erode once by window functions alone: a run over each kernel row's width, then the rows' largest or least."""
    from pyspark.sql import Window as W

    pick, many = (F.max, F.greatest) if op == "dilate" else (F.min, F.least)
    r = k // 2
    widths = (ellipse(k) if shape == "ellipse" else np.full(k, r)).tolist()
    across = W.partitionBy("camera_id", "y").orderBy("x")
    rows = mask.withColumns({f"__w{h}": pick("mask").over(across.rangeBetween(-h, h)) for h in sorted(set(widths))})
    down = W.partitionBy("camera_id", "x").orderBy("y")
    terms = [F.col(f"__w{h}") if d == r else F.lag(f"__w{h}", r - d).over(down) if d < r else F.lead(f"__w{h}", d - r).over(down) for d, h in enumerate(widths)]
    return rows.withColumn("__m", many(*terms)).select("camera_id", "y", "x", F.col("__m").alias("mask"))


def resize_array(a: np.ndarray, held: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """`a` at h by w, bilinear with matched pixel centres, and where any of the four places is `held`; beyond the edge is the edge."""
    at, part = [], []
    for n, to in zip(a.shape, (h, w), strict=True):
        s = (np.arange(to) + 0.5) * n / to - 0.5
        low = np.floor(s)
        at.append([np.clip(low + c, 0, n - 1).astype(int) for c in (0, 1)])
        part.append([1 - (s - low), s - low])
    v, any_held = np.zeros((h, w)), np.zeros((h, w), bool)
    for i in (0, 1):
        for j in (0, 1):
            place = np.ix_(at[0][i], at[1][j])
            v += a[place] * (part[0][i][:, None] * part[1][j])
            any_held |= held[place]
    return v, any_held


def _resized(key, t, to, names: list[str], whole: bool):
    """The map `t` (y, x, v) at the size that `to` gives for its own."""
    import pyarrow as pa

    y, x = t["y"].to_numpy(), t["x"].to_numpy()
    a = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
    held = np.zeros(a.shape, bool)
    a[y, x], held[y, x] = t["v"].to_numpy(), True
    v, kept = resize_array(a, held, *to(*a.shape))
    y, x = np.nonzero(kept)
    v = np.floor(v[y, x] + 0.5) if whole else v[y, x]
    return pa.table({c: pa.repeat(k, len(y)) for c, k in zip(names, key, strict=True)} | {"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "v": v})


def _maps(df: DataFrame, key: list[str]) -> tuple[DataFrame, str]:
    """df(key, y, x, v) with plain types, and the schema of what is made of it."""
    rows = df.select(*key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return rows, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)


def resize(df: DataFrame, scale: float, key: list[str], whole: bool = False) -> DataFrame:
    """df(key, y, x, v) at `scale`, bilinear; sizes are truncated, at least 1. A map is one group of bounded size, without a join on pixels."""
    rows, schema = _maps(df, key)
    to = lambda h, w: (max(int(h * scale), 1), max(int(w * scale), 1))
    return rows.groupBy(*key).applyInArrow(lambda k, t: _resized(k, t, to, key, whole), schema)


def resize_to(df: DataFrame, shape: DataFrame, key: list[str]) -> DataFrame:
    """df(key, y, x, v) brought to the sizes shape(key, h, w)."""
    rows, schema = _maps(df, key)
    shape = shape.select(*[F.col(c).alias(f"to_{c}") for c in key], F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"))

    def run(k, t, to):
        if not t.num_rows or not to.num_rows:
            return t.slice(0, 0)
        return _resized(k, t, lambda *_: (to["h"][0].as_py(), to["w"][0].as_py()), key, False)

    return rows.groupBy(*key).cogroup(shape.groupBy(*[f"to_{c}" for c in key])).applyInArrow(run, schema)
