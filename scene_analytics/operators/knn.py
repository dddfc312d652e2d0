"""Nearest neighbours by cosine or Euclidean distance, exact in blocks or approximate by hashing, and the graph they make."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import doubles, norm
from .errors import AnalysisError
from .lineage import stored
from .percentile import exact_percentile

BLOCK_ROWS = 2048
#: Blocks travel in groups of about so many bytes at most, or fewer where a task for each pair of groups would leave cores idle.
GROUP_BYTES = 8_000_000
#: Pairs of groups are dealt to four times as many tasks, as long as these are no more, so that few tasks get several.
SPREAD = 1000
#: Pairs that are measured at a time.
PAIRS = 1 << 14
#: From so many blocks on, groups first meet themselves and tell the others how near is near enough.
BOUND_BLOCKS = 16
#: Lists of rows whose neighbours in all groups come together: so many at most.
LISTS = 80_000


def _need_length(df: DataFrame) -> None:
    if not df.where(norm(doubles(F.col("embedding"))) == 0).limit(1).isEmpty():
        raise AnalysisError("a vector without length has no cosine distance")


def _kind(df: DataFrame) -> str:
    return "<f4" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"  # as it is shipped; products are of doubles


def _groups(df: DataFrame, block_rows: int, item: int) -> tuple[int, int]:
    """(number of rows, into how many groups they are dealt): few, as each group meets all groups and is shipped so many times; at most one for each block."""
    n, dims = df.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return n, max(1, min(-(-n // block_rows), max(-(-n * dims * item // GROUP_BYTES), math.ceil(math.sqrt(6 * cores)))))


def _few_bytes_at_once(spark: SparkSession) -> None:
    """An Arrow batch holds one pair of large groups, not as many as fit the session's limit; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub("[^0-9-]", "", spark.conf.get(key)) or 0)
    if not 0 < now <= GROUP_BYTES:
        spark.conf.set(key, GROUP_BYTES)


def _similar(x: np.ndarray, metric: str, first: bool, kind) -> np.ndarray:
    """Rows whose products, one side's `first`, are the cosine or minus half the squared distance."""
    x = x.astype(float)
    if metric == "cosine":
        return (x / np.linalg.norm(x, axis=1)[:, None]).astype(kind)
    half, one = -(x**2).sum(1)[:, None] / 2, np.ones((len(x), 1))
    return np.hstack([x, half, one] if first else [x, one, half]).astype(kind)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(1))


def _exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, metric: str, lengths: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distances of the rows a of x and b of y, in doubles, so many pairs at a time."""
    d = np.empty(len(a))
    for i in range(0, len(a), PAIRS):
        p, q = a[i : i + PAIRS], b[i : i + PAIRS]
        v, w = x[p].astype(float), y[q].astype(float)
        d[i : i + PAIRS] = 1 - (v * w).sum(1) / lengths[0][p] / lengths[1][q] if metric == "cosine" else np.sqrt(((v - w) ** 2).sum(1))
    return d


class _Lists:
    """The k nearest so far of each of `n` rows, ties to smaller ids; `limit`, one or one for each row: what isn't nearer than it doesn't count."""

    def __init__(self, n: int, k: int, limit: float | np.ndarray):
        self.k, self.limit = k, np.broadcast_to(limit, n)
        self.d, self.to = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)

    def reach(self, cut: slice) -> np.ndarray:
        return np.minimum(self.d[cut, -1], self.limit[cut])

    def add(self, row: np.ndarray, to: np.ndarray, d: np.ndarray) -> None:
        near = (d <= self.d[row, -1]) & (d < self.limit[row])
        row, to, d = row[near], to[near], d[near]
        if not len(row):
            return
        some = np.unique(row)
        held = np.isfinite(self.d[some])
        s = np.concatenate([np.repeat(some, held.sum(1)), row])
        t, e = np.concatenate([self.to[some][held], to]), np.concatenate([self.d[some][held], d])
        order = np.lexsort((t, e, s))
        s = s[order]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        near = place < self.k
        order = order[near]
        self.d[s[near], place[near]], self.to[s[near], place[near]] = e[order], t[order]

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.isfinite(self.d)
        return np.repeat(ids, at.sum(1)), self.to[at], self.d[at]


def _kth(m: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least k of its entries reach, all if there are fewer: near the k-th largest one."""
    wide = max(1, m.shape[1] // (16 * k))
    many = m.shape[1] // wide
    top = m[:, :many].copy()
    for i in range(1, wide):  # the largest of every `wide` entries, which are different ones
        np.fmax(top, m[:, i * many : (i + 1) * many], out=top)
    top = np.fmax(top, top.dtype.type(-np.inf))  # what isn't a number is reached by none
    at = many - min(k, many)
    return np.partition(top, at, axis=1)[:, at]


def _places(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of what is true, which is little: eight entries are looked at together."""
    flat = near.ravel()
    whole = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    some = np.concatenate([some[flat[some]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(some, near.shape[1])


def _screen(x: np.ndarray, y: np.ndarray, metric: str):
    """(type, rows of x, rows of y, slack, least): a product of these rows is right to `slack`; `least` is what one of a distance reaches."""
    small = x.dtype.itemsize == 4 and (metric == "cosine" or max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < 1e15)
    kind = np.float32 if small else np.float64
    size = 1.0 if metric == "cosine" else float(max((x.astype(float) ** 2).sum(1).max(initial=0), (y.astype(float) ** 2).sum(1).max(initial=0))) * 2
    slack = (x.shape[1] + 16) * 2 * float(np.finfo(kind).eps) * size
    least = (lambda d: 1 - d - slack) if metric == "cosine" else (lambda d: -d * d / 2 - slack)
    return kind, _similar(x, metric, True, kind), _similar(y, metric, False, kind), slack, least


def _within(x: np.ndarray, ids: np.ndarray, reach: np.ndarray, y: np.ndarray, other: np.ndarray, far: np.ndarray, k: int, metric: str, block_rows: int) -> tuple[_Lists, _Lists]:
    """For rows of x the k nearest of y that are no farther than `reach`, and for rows of y those of x no farther than `far`.

    One product serves both sides. No row is in both.
    """
    kind, a, b, slack, least = _screen(x, y, metric)
    lengths = _lengths(x), _lengths(y)
    one, two = (_Lists(len(r), k, np.nextafter(r, np.inf)) for r in (reach, far))
    bound = lambda lists: np.nextafter(least(lists.reach(slice(None))).astype(kind), kind(-np.inf))
    high, low, least_far, waiting, many = max(1, block_rows // 4), bound(one), bound(two), [], 0

    def measure():
        for lists, side, u, v, names, norms in ((one, 0, x, y, other, lengths), (two, 1, y, x, ids, lengths[::-1])):
            row, to = (np.concatenate([w[2 * side + c] for w in waiting]) for c in (0, 1))
            lists.add(row, names[to], _exact(u, v, row, to, metric, norms))
        waiting.clear()

    for i in range(0, len(x), high):
        for j in range(0, len(y), block_rows):
            m = a[i : i + high] @ b[j : j + block_rows].T
            near, back = m >= low[i : i + high, None], m >= least_far[None, j : j + block_rows]
            if np.count_nonzero(near) > 4 * k * m.shape[0]:
                near &= m >= (_kth(m, k) - kind(2 * slack))[:, None]
            if np.count_nonzero(back) > 4 * k * m.shape[1]:
                back &= m >= (_kth(m.T, k) - kind(2 * slack))[None]
            g, h = _places(near | back)
            hit, met = near[g, h], back[g, h]
            waiting.append((g[hit] + i, h[hit] + j, h[met] + j, g[met] + i))
            many += len(g)
            if many > 64 * PAIRS:  # copies may all be equally near
                measure()
                low, least_far, many = bound(one), bound(two), 0
    if waiting:
        measure()
    return one, two


def _nearest(ids: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, k: int, metric: str, block_rows: int, both: bool = False, limit: float = np.inf, allowed=None):
    """(src, dst, distance): for each row of x the k nearest of y and, with `both`, for each of y the k nearest of x.

    A product of floats, right to `slack`, leaves out what surely is farther than the k-th so far; the rest is measured in doubles.
    `ids` and `other` rise. `allowed` (rows of x, rows of y) says which pairs count; pairs of a row with itself don't.
    """
    kind, a, b, slack, least = _screen(x, y, metric)
    lengths = _lengths(x), _lengths(y)
    sides = [(ids, x, a, lengths, other, y, b, allowed)]
    if both and x is not y:
        turned = allowed and (lambda own, their, g=None, h=None: allowed(their, own).T if g is None else allowed(their, own, h, g))
        sides.append((other, y, b, lengths[::-1], ids, x, a, turned))
    found = []
    for own_ids, u, own_rows, norms, their_ids, v, their_rows, may in sides:
        lists = _Lists(len(u), k, limit)
        # A strip of rows meets all others at once, in a product of at most a block's size; where pairs have to be allowed, block by block.
        width = max(1, len(v) if may is None else block_rows)
        high = max(1, block_rows * block_rows // width)
        for i in range(0, len(u), high):
            for j in range(0, len(v), width):
                own, their = slice(i, i + high), slice(j, j + width)
                m = own_rows[own] @ their_rows[their].T
                at = np.searchsorted(their_ids[their], own_ids[own])
                self_at = np.flatnonzero(at < m.shape[1])
                self_at = self_at[their_ids[their][at[self_at]] == own_ids[own][self_at]]
                m[self_at, at[self_at]] = -np.inf
                bound = np.nextafter(least(lists.reach(own)).astype(kind), kind(-np.inf))
                near = m >= bound[:, None] if j or limit < np.inf else None
                if near is None or np.count_nonzero(near) > 4 * k * len(bound):
                    if may is not None:
                        m[~may(own, their)] = -np.inf
                    near = m >= np.maximum(bound, _kth(m, k) - kind(2 * slack))[:, None]
                g, h = _places(near)  # places in the strip and in the block
                keep = own_ids[own][g] != their_ids[their][h]
                if may is not None and len(g):
                    keep &= may(own, their, g, h)
                g, h = g[keep], h[keep]
                for c in range(0, len(g), 64 * PAIRS):  # copies may all be equally near
                    cut = slice(c, c + 64 * PAIRS)
                    lists.add(g[cut] + i, their_ids[their][h[cut]], _exact(u, v, g[cut] + i, h[cut] + j, metric, norms))
        found.append(lists.found(own_ids))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


LISTED = "part int, strip int, src binary, dst binary, distance binary"
FOUND = "src long, dst long, distance double"


def _bounded(df: DataFrame, k: int, metric: str, block_rows: int, groups: int) -> DataFrame:
    """(part, strip, src, dst, distance): packed lists of neighbours, for each strip of a group those in each group.

    Groups first meet themselves. A row's k-th neighbour there bounds its neighbours in other groups, so that little of a product is
    looked at, and one product serves both groups. A strip's lists are LISTS at most, times k.
    """
    import pyarrow as pa

    kind, high = _kind(df), max(1, LISTS // groups)

    def pack(key, t):
        ids = t["vec_id"].to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order].astype(kind)
        src, dst, d = _nearest(ids, v, ids, v, k, metric, block_rows, True)
        first, last = np.searchsorted(src, ids), np.searchsorted(src, ids, "right")
        reach = np.full(len(ids), np.inf)
        full = last - first == k
        reach[full] = d[last[full] - 1]
        held = {"ids": ids, "v": v, "reach": reach, "src": src, "dst": dst, "distance": d}
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())} | {c: pa.array([a.tobytes()], pa.binary()) for c, a in held.items()})

    rows = df.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"), "vec_id", F.col("embedding").alias("v"))
    dealt = rows.repartition(min(4 * groups, SPREAD), "part").groupBy("part")
    packed = stored(dealt.applyInArrow(pack, "part int, ids binary, v binary, reach binary, src binary, dst binary, distance binary"))

    def strips(part: int, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, d: np.ndarray):
        cuts = np.searchsorted(src, ids[::high]).tolist() + [len(src)]
        some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        held = [pa.array([c[a:b].tobytes() for _, a, b in some], pa.binary()) for c in (src, dst, d)]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array([i for i, _, _ in some], pa.int32()), *held], names=["part", "strip", "src", "dst", "distance"])

    def column(batch, c, i, t=np.int64):
        return np.frombuffer(batch.column(c)[i].as_buffer(), t)

    def own(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield strips(b.column("part")[i].as_py(), column(b, "ids", i), column(b, "src", i), column(b, "dst", i), column(b, "distance", i, float))

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (p, ids, x, reach), (q, other, y, far) = (
                    (batch.column(s)[i].as_py(), n, column(batch, f"v_{s}", i, kind).reshape(len(n), -1), column(batch, f"reach_{s}", i, float)) for s in "ab" for n in [column(batch, f"ids_{s}", i)]
                )
                one, two = _within(x, ids, reach, y, other, far, k, metric, block_rows)
                yield strips(p, ids, *one.found(ids))
                yield strips(q, other, *two.found(other))

    _few_bytes_at_once(df.sparkSession)
    pairs = groups * (groups - 1) // 2
    tasks = max(pairs, min(4 * pairs, SPREAD), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # with fewer the join deals anew
    after, before = F.explode(F.sequence(F.col("part") + 1, F.lit(groups - 1))), F.explode(F.sequence(F.lit(0), F.col("part") - 1))
    side = lambda s, a, b: packed.where(F.col("part") < groups - 1 if s == "a" else F.col("part") > 0).select(a.alias("a"), b.alias("b"), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "v", "reach")]).repartition(tasks, "a", "b")
    met = side("a", F.col("part"), after).join(side("b", before, F.col("part")), ["a", "b"]).mapInArrow(meet, LISTED)
    return packed.select("part", "ids", "src", "dst", "distance").mapInArrow(own, LISTED).unionByName(met)


def _unpacked(t) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x.as_buffer() for x in t[c] if x.is_valid), kind) for c, kind in (("src", np.int64), ("dst", np.int64), ("distance", float))]


def _listed(lists: DataFrame) -> DataFrame:
    """(src, dst, distance) of packed lists."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _unpacked(pa.table(b.columns, names=b.schema.names))], names=["src", "dst", "distance"])

    return lists.mapInArrow(run, FOUND)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance, rank): of packed lists each row's k nearest, ties to smaller ids."""
    import pyarrow as pa

    def run(t):
        src, dst, d = _unpacked(t)
        order = np.lexsort((dst, d, src))
        src, dst, d = src[order], dst[order], d[order]
        rank = np.arange(len(src)) - np.searchsorted(src, src) + 1
        near = rank <= k
        return pa.table({"src": src[near], "dst": dst[near], "distance": d[near], "rank": pa.array(rank[near], pa.int32())})

    return lists.groupBy("part", "strip").applyInArrow(run, FOUND + ", rank int")


def candidates(df: DataFrame, k: int = 15, metric: str = "cosine", block_rows: int = BLOCK_ROWS, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, distance): near other rows of each row in each group of rows, at most k; of all these k are the nearest."""
    n, groups = _groups(df, block_rows, np.dtype(_kind(df)).itemsize)
    if sources is None and _many(n, groups, block_rows):
        return _listed(_bounded(df, k, metric, block_rows, groups))
    return _paired(df, k, metric, block_rows, sources, groups)


def _many(n: int, groups: int, block_rows: int) -> bool:
    return groups > 1 and n >= BOUND_BLOCKS * block_rows


def _paired(df: DataFrame, k: int, metric: str, block_rows: int, sources: DataFrame | None, groups: int) -> DataFrame:
    """`candidates` without bounds: every pair of groups leaves k rows of each source."""
    import pyarrow as pa

    kind = _kind(df)
    asked = df if sources is None else df.join(sources.select("vec_id"), "vec_id", "left_semi")
    strips = groups if sources is None else _groups(asked, block_rows, np.dtype(kind).itemsize)[1]

    def pack(key, t):
        ids = t["vec_id"].to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "v": [v[order].astype(kind).tobytes()]})

    def packed(rows, n):
        rows = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("part"), "vec_id", F.col("embedding").alias("v"))
        return rows.groupBy("part").applyInArrow(pack, "part int, ids binary, v binary")

    both = sources is None  # then a pair of groups meets once, and each gets its neighbours in the other
    spread = lambda first, n: F.explode(F.sequence(first, F.lit(n - 1)))
    left = packed(asked, strips).select(F.col("part").alias("a"), spread(F.col("part") if both else F.lit(0), groups).alias("b"), F.col("ids").alias("ids_a"), F.col("v").alias("va"))
    right = packed(df, groups).select(F.explode(F.sequence(F.lit(0), F.col("part"))).alias("a") if both else spread(F.lit(0), strips).alias("a"), F.col("part").alias("b"), F.col("ids").alias("ids_b"), F.col("v").alias("vb"))

    def nearest(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                ids, other = held("ids_a", np.int64), held("ids_b", np.int64)
                x, y = held("va", kind).reshape(len(ids), -1), held("vb", kind).reshape(len(other), -1)
                if both and batch.column("a")[i] == batch.column("b")[i]:
                    y = x
                found = _nearest(ids, x, other, y, k, metric, block_rows, both)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["src", "dst", "distance"])

    _few_bytes_at_once(df.sparkSession)
    pairs = groups * (groups + 1) // 2 if both else strips * groups
    tasks = max(pairs, min(4 * pairs, SPREAD), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # with fewer the join deals anew
    deal = lambda rows: rows.repartition(tasks, "a", "b")
    return deal(left).join(deal(right), ["a", "b"]).mapInArrow(nearest, "src long, dst long, distance double")


def top_k(df: DataFrame, k: int = 15, metric: str = "cosine", block_rows: int = BLOCK_ROWS, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, distance, rank): the k nearest other rows of each row, ties to smaller ids; all others if there are fewer.

    `sources` (vec_id) are the rows whose neighbours are asked for, all by default. Rows are packed into groups of blocks; a task takes
    a pair of groups, a matrix product for each pair of blocks, and k rows of each source leave it. All rows' groups meet once.
    Vectors without length have no cosine and raise an error.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    if metric == "cosine":
        _need_length(df)
    n, groups = _groups(df, block_rows, np.dtype(_kind(df)).itemsize)
    if sources is None and _many(n, groups, block_rows):
        return _merged(_bounded(df, k, metric, block_rows, groups), k)
    rank = F.row_number().over(W.partitionBy("src").orderBy("distance", "dst"))
    return _paired(df, k, metric, block_rows, sources, groups).withColumn("rank", rank).where(F.col("rank") <= k)


def similarities(neighbours: DataFrame, metric: str = "cosine") -> DataFrame:
    """(src, dst, similarity): 1 - distance, or a Gaussian whose width is the median of all neighbour distances."""
    if metric == "cosine":
        return neighbours.select("src", "dst", (1 - F.col("distance")).alias("similarity"))
    width = F.broadcast(exact_percentile(neighbours, "distance", 0.5, "sigma"))
    return neighbours.crossJoin(width).select("src", "dst", F.exp(-F.col("distance") * F.col("distance") / (2 * F.col("sigma") * F.col("sigma"))).alias("similarity"))


def symmetric_edges(sims: DataFrame) -> DataFrame:
    """(src, dst, weight) both ways: the two directions add up, at most 1; weights of zero vanish, negative ones stay."""
    both = sims.select("src", "dst", "similarity").union(sims.select(F.col("dst"), F.col("src"), "similarity"))
    return both.groupBy("src", "dst").agg(F.least(F.sum("similarity"), F.lit(1.0)).alias("weight")).where("weight <> 0")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def top_k_lsh(df: DataFrame, k: int = 15, bucket: float = 1.0, tables: int = 8, reach: float = 1.2, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate top_k by random projections; rows with fewer than k neighbours within `reach` on the unit sphere get theirs from top_k.

    Candidates share a bucket of one of the tables. Buckets are cut into groups of blocks, which meet as in `top_k`; a pair counts in its first common bucket. Where the buckets together hold more pairs than there are, all rows are one bucket and
    each pair is looked at once.
    """
    import pyarrow as pa
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..functions.vectors import l2_normalize

    _need_length(df)
    kind = _kind(df)
    unit = df.select("vec_id", "embedding", array_to_vector(l2_normalize(F.col("embedding"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    codes = F.array(*[vector_to_array(F.element_at("h", i + 1))[0].cast("long") for i in range(tables)])
    hashed = model.transform(unit).select("vec_id", "embedding", codes.alias("codes"))
    sizes = stored(hashed.select(F.posexplode("codes").alias("t", "h")).groupBy("t", "h").agg(F.count("*").alias("n")))
    pairs, times = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum("n")).first()
    n = (times or 0) // tables
    if (pairs or 0) < n * n:
        dealt = hashed.select("*", F.posexplode("codes").alias("t", "h")).join(sizes, ["t", "h"])
    else:
        dealt = hashed.select("*", F.lit(-1).alias("t"), F.lit(0).cast("long").alias("h"), F.lit(n).cast("long").alias("n"))
    # A bucket's groups are large, as each is shipped to all of them; small buckets are one.
    width = df.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0] * np.dtype(kind).itemsize + 8 * tables
    share = F.ceil(F.col("n") * math.sqrt(6 * df.sparkSession.sparkContext.defaultParallelism) / max(n, 1))
    blocks = F.least(F.ceil(F.col("n") / block_rows), F.greatest(F.ceil(F.col("n") * width / GROUP_BYTES), share))
    dealt = dealt.withColumn("blocks", blocks.cast("int"))
    dealt = dealt.select("t", "h", "blocks", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "embedding", "codes")

    def pack(key, t):
        v = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).tobytes()
        c = t["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).tobytes()
        at = {name: pa.array([x.as_py()], pa.int64()) for name, x in zip(("t", "h", "blocks", "block"), key, strict=True)}
        return pa.table(at | {"ids": [t["vec_id"].to_numpy().astype(np.int64).tobytes()], "c": [c], "v": [v]})

    packed = dealt.groupBy("t", "h", "blocks", "block").applyInArrow(pack, "t long, h long, blocks long, block long, ids binary, c binary, v binary")
    first = F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))
    last = F.explode(F.sequence(F.lit(0).cast("long"), F.col("block")))
    side = lambda s, own, other, spread: packed.select("t", "h", F.col("block").alias(own), spread.alias(other), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "c", "v")])

    def nearest(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                (ids, c, x), (other, e, y) = ((n, held(f"c_{s}", np.int64).reshape(len(n), tables), held(f"v_{s}", kind).reshape(len(n), -1)) for s in "ab" for n in [held(f"ids_{s}", np.int64)])
                t = batch.column("t")[i].as_py()
                if batch.column("p")[i] == batch.column("q")[i]:
                    y = x

                def allowed(mine, far, g=None, h=None):
                    """Whether rows share a bucket of any table or, in one table's bucket, none of a table before."""
                    one, two = (c[mine][:, None], e[far]) if g is None else (c[mine][g], e[far][h])  # noqa: B023
                    common = np.zeros(np.broadcast_shapes(one.shape, two.shape)[:-1], bool)
                    for j in range(tables if t < 0 else t):  # noqa: B023
                        common |= one[..., j] == two[..., j]
                    return common if t < 0 else ~common  # noqa: B023

                found = _nearest(ids, x, other, y, k, "cosine", block_rows, True, reach * reach / 2, allowed)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["src", "dst", "distance"])

    _few_bytes_at_once(df.sparkSession)
    rank = F.row_number().over(W.partitionBy("src").orderBy("distance", "dst"))
    near = side("a", "p", "q", first).join(side("b", "q", "p", last), ["t", "h", "p", "q"]).mapInArrow(nearest, "src long, dst long, distance double")
    found = stored(near.withColumn("rank", rank).where(F.col("rank") <= k))
    full = found.where(F.col("rank") == k).select("src")
    lacking = stored(df.select("vec_id").join(full.withColumnRenamed("src", "vec_id"), "vec_id", "left_anti"))
    kept = found.join(full, "src", "left_semi").select(*found.columns)
    return kept if lacking.isEmpty() else kept.unionByName(top_k(df, k, sources=lacking).select(*found.columns))
