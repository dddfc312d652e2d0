"""Whitening of embeddings by a tall-and-skinny QR and one-sided Jacobi rotations.

Each task centres its rows and keeps one triangle R of them; triangles are stacked and factored again, a few at a time, until one is
left. Plane rotations make the columns of that R orthogonal: the rotations together are the components, the columns' lengths their
standard deviations, small ones as accurate as large ones, since no product of R with itself is formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, materialize_table, table

#: Triangles that are stacked in one step.
FAN_IN = 16
BLOCK_ROWS = 4096
SWEEPS = 60
#: Components whose standard deviation is a smaller share of the largest are without variance.
RANK_SHARE = 1e-12


def triangle(blocks, dims: int) -> np.ndarray:
    """R (dims x dims) of all rows of `blocks`, one block at a time: R.T @ R is their X.T @ X."""
    r = np.zeros((0, dims))
    for x in blocks:
        r = np.linalg.qr(np.vstack([r, x]), mode="r")
    return np.vstack([r, np.zeros((dims - len(r), dims))]) if len(r) < dims else r


def jacobi_svd(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, v): singular values of `r`, falling, and its right singular vectors as the columns of `v`, by one-sided Jacobi rotations.

    A sweep meets every pair of columns once, in rounds of pairs that have no column in common. Columns start by falling length. Raises
    ArithmeticError if SWEEPS sweeps leave two columns that aren't orthogonal to double precision.
    """
    d = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    a, v = np.array(r[:, order], float), np.eye(d)[:, order]
    ring = list(range(d + d % 2))  # a seat over is an idle one
    tiny = np.finfo(float).tiny
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(len(ring) - 1, 0)):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1], strict=True) if max(x, y) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > np.maximum(np.finfo(float).eps * np.sqrt(alpha) * np.sqrt(beta), tiny)
            if not turn.any():
                continue
            turned = True
            p, q, x, y, alpha, beta, gamma = p[turn], q[turn], x[:, turn], y[:, turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    else:
        raise ArithmeticError("rotations did not settle")
    s = np.linalg.norm(a, axis=0)
    order = np.argsort(-s, kind="stable")
    return s[order], v[:, order]


def _column(batch, name: str) -> np.ndarray:
    """A list column whose lists all have one length, as rows."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(parts: DataFrame, column: str, value) -> list:
    """Entry by entry, the sums of an array column of few rows a task; the arrays' length is bounded by the dimensions."""
    summed = parts.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    return [value(x) for _, x in sorted((r["i"], r["x"]) for r in summed)]


class Whitening:
    """n, the sums of each dimension, the components as columns, each one's variance and share of all variance; small things all."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, variances: np.ndarray, explained: np.ndarray):
        self.n, self.sums, self.components, self.variances, self.explained = n, np.array(sums, np.int64), components, variances, explained

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Exact but for the one division: n * x - S is a whole number."""
        return (self.n * x - self.sums) / self.n


def whole_rows(df: DataFrame, vector: str, key: str, scale: int) -> DataFrame:
    """(`key`, x array of long): floor(scale * entry) of each vector that may take part.

    Vectors that are null, empty or hold a null or non-finite entry take no part, nor do those shorter than the longest one that is
    left. Entries beyond a long's range end there.
    """
    c = F.col(f"`{vector}`")
    good = df.where(c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = good.select(F.col(f"`{key}`").alias(key), F.transform(c, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("x"))
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    return rows.where(F.size("x") == (dims or 0))


def fit(rows: DataFrame, most: int) -> Whitening | None:
    """The `most` components of largest variance of `rows` (x array of long, all of one length); None if there is no row.

    Components without variance are left out. Two passes: sums, then triangles of centred rows, each R as large as the dimensions
    squared, FAN_IN of them in a task. Only the sums, the last R's components and variances reach the driver.
    """
    import pyarrow as pa

    def sums(batches):
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = _column(b, "x").sum(0)
                total, n = x if total is None else total + x, n + b.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": pa.array([total.tolist()], pa.list_(pa.int64()))})

    parts = materialize(arrow_map(rows.select("x"), sums, "n long, s array<long>"))
    n = parts.agg(F.sum("n")).first()[0]
    if not n:
        return None
    w = Whitening(n, _summed(parts, "s", int), np.empty((0, 0)), np.empty(0), np.empty(0))
    dims = len(w.sums)

    def factored(batches):
        blocks = (w.centred(x[i : i + BLOCK_ROWS]) for b in batches if b.num_rows for x in [_column(b, "x")] for i in range(0, len(x), BLOCK_ROWS))
        yield pa.RecordBatch.from_pydict({"r": [triangle(blocks, dims).tobytes()]})

    def stacked(t):
        r = triangle((np.frombuffer(x, float).reshape(dims, dims) for x in t["r"].to_pylist()), dims)
        return pa.table({"r": [r.tobytes()]})

    left = materialize(arrow_map(rows.select("x"), factored, "r binary"))
    while (count := left.count()) > 1:
        groups = -(-count // FAN_IN)
        lots = left.withColumn("lot", F.pmod(F.spark_partition_id() if groups > 1 else F.lit(0), F.lit(groups)))
        left = materialize(lots.groupBy("lot").applyInArrow(lambda t: stacked(t), "r binary"))

    def rotated(batches):
        for b in batches:
            for r in b.column("r").to_pylist():
                s, v = jacobi_svd(np.frombuffer(r, float).reshape(dims, dims))
                yield pa.RecordBatch.from_pydict({"s": [s.tobytes()], "v": [v.tobytes()]})

    found = left.mapInArrow(rotated, "s binary, v binary").first()
    s, v = np.frombuffer(found["s"], float), np.frombuffer(found["v"], float).reshape(dims, dims)
    kept = min(most, int((s > s[0] * RANK_SHARE).sum()) if s[0] > 0 else 0)
    return Whitening(n, w.sums.tolist(), v[:, :kept], s[:kept] ** 2 / n, s[:kept] ** 2 / max((s**2).sum(), np.finfo(float).tiny))


def whiten(rows: DataFrame, key: str, w: Whitening) -> DataFrame:
    """(`key`, deviation long, whitened array of double): each row on the components over their standard deviations.

    deviation is the sum over dimensions of (n * x - S) squared, exact; a sum beyond a long's range raises OverflowError.
    """
    import pyarrow as pa

    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        scaled = w.components / np.sqrt(w.variances)
        for b in batches:
            if not b.num_rows:
                continue
            x = _column(b, "x")
            apart = w.n * x - w.sums
            far = w.n * x.astype(float) - w.sums  # in case the whole numbers themselves went round
            if (far**2).sum(1).max(initial=0) >= 2.0**63:
                raise OverflowError("a deviation beyond a long's range")
            white = ((apart / w.n) @ scaled).ravel()
            k = scaled.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * k, pa.int32()), pa.array(white))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array((apart * apart).sum(1)), lists], names=[key, "deviation", "whitened"])

    return arrow_map(rows.select(f"`{key}`", "x"), run, f"`{key}` {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, n: int) -> float:
    """The largest absolute entry of the whitened columns' covariance (divisor n) minus the identity; a product for each task."""
    import pyarrow as pa

    def products(batches):
        total, k = None, 0
        for b in batches:
            if b.num_rows:
                x = _column(b, "whitened")
                k = x.shape[1]
                p = np.concatenate([x.sum(0), (x.T @ x).ravel()])
                total = p if total is None else total + p
        if k:
            yield pa.RecordBatch.from_pydict({"p": pa.array([total.tolist()], pa.list_(pa.float64()))})

    entries = np.array(_summed(arrow_map(white.select("whitened"), products, "p array<double>"), "p", float))
    k = int(round((np.sqrt(1 + 4 * len(entries)) - 1) / 2))
    mean = entries[:k] / n
    return float(np.abs(entries[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of embeddings that takes part and each of up to 32 components; edge cases as in `whole_rows` and `fit`.

    Repeated rows and ids are rows of their own. Without any row, or any variance, the result is empty. The contract's x is a million
    larger than the one used here, which changes no difference.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = materialize_table(whole_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "vec_id", 64))
    w = fit(rows, 32)
    if w is None or not len(w.variances):
        return spark.createDataFrame([], schema)
    white = materialize_table(whiten(rows, "vec_id", w))
    error = identity_error(white, w.n)
    explained = F.array(*[F.lit(float(x)) for x in w.explained])
    each = white.select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
