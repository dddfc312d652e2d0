"""Approximate nearest neighbours by descent: a forest of random projections for a start, then neighbours of neighbours.

Each round, every row brings together some of its neighbours and of the rows whose neighbour it is; those that haven't met yet are
compared, and what is nearer than a row's farthest neighbour takes its place. The work of a round grows with the number of rows, the
number of rounds hardly at all. Vectors travel as bytes; the neighbours that are left are compared again as they are stored.
"""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import doubles, norm
from .errors import AnalysisError
from .knn import top_k
from .lineage import drop_stored, stored

#: Neighbours kept for each one that is asked for, and how many new and as many old ones meet each round, each way.
POOL, MEET = 4, 24
#: Trees of the start, rows of a leaf, and rows that the trees' medians are taken of.
TREES, LEAF, FIT_ROWS = 3, 512, 8192
#: Rounds end when fewer than this share of all neighbours are new, or after so many.
SETTLED, ROUNDS = 0.02, 16
#: Rows whose lists are one group, and rows whose meetings are one group at most.
LOT_ROWS, MEET_ROWS = 2048, 32768

STATE = "vec_id long, code binary, scale float, ids binary, sims binary, fresh binary, least float"
FOUND = "src long, dst long, sim float"
NOTHING = np.float32(-2.0)


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as signed bytes and what a byte's step is worth."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _binary(rows: np.ndarray):
    """An Arrow column of the bytes of each row."""
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    at = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(rows.tobytes())])


def _rows(column, kind) -> np.ndarray:
    """The rows of a column of `_binary`."""
    held = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    whole = b"".join(x.as_buffer() for x in held)
    return np.frombuffer(whole, kind).reshape(len(held), -1) if len(held) else np.empty((0, 0), kind)


def _units(t, code: str = "code", scale: str = "scale") -> np.ndarray:
    return _rows(t[code], np.int8).astype(np.float32) * t[scale].to_numpy().astype(np.float32)[:, None]


def _found(src, dst, sim):
    import pyarrow as pa

    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "sim": pa.array(sim, pa.float32())})


def _forest(df: DataFrame, n: int, leaf: int, seed: int) -> list[list[np.ndarray]]:
    """For each tree its levels: a matrix of a direction and a median for each node, fitted to at most FIT_ROWS rows drawn by hash.

    A leaf gets about `leaf` rows, but at least 8 of those drawn; where that leaves more of all rows, they are dealt by hash.
    """
    drawn = df.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(FIT_ROWS).select("embedding").collect()
    x = np.array([r[0] for r in drawn], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    depth = 0
    while n / (1 << depth) > leaf and len(x) / (1 << depth + 1) >= 8:
        depth += 1
    rng, trees = np.random.default_rng(seed), []
    for _ in range(TREES):
        node, levels = np.zeros(len(x), int), []
        for level in range(depth):
            cut = np.zeros((1 << level, x.shape[1] + 1))
            for k in range(1 << level):
                rows = np.flatnonzero(node == k)
                a, b = x[rng.choice(rows, 2)] if len(rows) else x[rng.integers(0, len(x), 2)]
                way = a - b if np.any(a != b) else rng.normal(size=x.shape[1])
                cut[k] = [*way, np.median(x[rows] @ way) if len(rows) else 0.0]
            node = 2 * node + ((x * cut[node, :-1]).sum(1) > cut[node, -1])
            levels.append(cut)
        trees.append(levels)
    return trees


def _start(df: DataFrame, n: int, pool: int, leaf: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(the rows' codes, what rows of common leaves say of each other)."""
    import pyarrow as pa

    trees = _forest(df, n, leaf, seed)

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            leaves = []
            for levels in trees:
                node = np.zeros(len(x), int)
                for cut in levels:
                    node = 2 * node + ((unit * cut[node, :-1]).sum(1) > cut[node, -1])
                leaves.append(node)
            codes, scale = _codes(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(trees), pa.int32()), pa.array(np.stack(leaves, 1).ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(codes), pa.array(scale), lists], names=["vec_id", "code", "scale", "leaves"])

    coded = stored(df.select("vec_id", "embedding").mapInArrow(code, "vec_id long, code binary, scale float, leaves array<int>"))
    placed = coded.select("vec_id", "code", "scale", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "tree"), "blocks").cast("int"))

    def meet(t):
        ids, x = t["vec_id"].to_numpy(), _units(t)
        many = min(pool, len(ids) - 1)
        if many < 1:
            return _found([], [], [])
        s = x @ x.T
        np.fill_diagonal(s, NOTHING)
        near = np.argpartition(-s, many - 1, axis=1)[:, :many]
        src = np.repeat(np.arange(len(ids)), many)
        return _found(ids[src], ids[near.ravel()], s[src, near.ravel()])

    return coded.select("vec_id", "code", "scale"), dealt.groupBy("tree", "leaf", "block").applyInArrow(meet, FOUND)


def _merged(state: DataFrame, found: DataFrame, n: int, pool: int) -> DataFrame:
    """The lists after `found`: of each row's old and new neighbours the `pool` nearest, ties to smaller ids; new ones are fresh."""
    import pyarrow as pa

    lots = max(1, n // LOT_ROWS)
    lot = lambda c: F.pmod(F.xxhash64(c), F.lit(lots)).alias("lot")

    def run(left, right):
        ids = left["vec_id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        held = [_rows(left[c], kind)[order] for c, kind in (("ids", np.int64), ("sims", np.float32), ("fresh", bool))]
        m = len(ids)
        src = np.concatenate([np.repeat(np.arange(m), held[0].shape[1]), np.searchsorted(ids, right["src"].to_numpy())])
        dst = np.concatenate([held[0].ravel(), right["dst"].to_numpy()])
        sim = np.concatenate([held[1].ravel(), right["sim"].to_numpy().astype(np.float32)])
        old = np.concatenate([np.ones(held[0].size, bool), np.zeros(right.num_rows, bool)])
        fresh = np.concatenate([held[2].ravel(), np.ones(right.num_rows, bool)])
        order_in = np.lexsort((~old, dst, src))  # of a pair told again the one that is held
        src, dst, sim, fresh = (c[order_in] for c in (src, dst, sim, fresh))
        once = np.ones(len(src), bool)
        once[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
        once &= sim > NOTHING
        src, dst, sim, fresh = (c[once] for c in (src, dst, sim, fresh))
        order_in = np.lexsort((dst, -sim, src))
        src, dst, sim, fresh = (c[order_in] for c in (src, dst, sim, fresh))
        place = np.arange(len(src)) - np.searchsorted(src, src)
        near = place < pool
        out = [np.full((m, pool), -1, np.int64), np.full((m, pool), NOTHING, np.float32), np.zeros((m, pool), bool)]
        for a, c in zip(out, (dst, sim, fresh), strict=True):
            a[src[near], place[near]] = c[near]
        back = np.argsort(order)
        lists = [_binary(a[back]) for a in out]
        return pa.table({"vec_id": left["vec_id"], "code": left["code"], "scale": left["scale"], "ids": lists[0], "sims": lists[1], "fresh": lists[2], "least": pa.array(out[1][back, -1])})

    both = state.withColumn("lot", lot("vec_id")).groupBy("lot").cogroup(found.withColumn("lot", lot("src")).groupBy("lot"))
    return both.applyInArrow(lambda a, b: run(a, b), STATE)


def _chosen(state: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(state with those that meet no longer fresh, (center, member, fresh) of who meets whom at whose place)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fresh, ids = _rows(b.column("fresh"), bool), _rows(b.column("ids"), np.int64)
            rng = np.random.default_rng([turn, int(b.column("vec_id")[0].as_py()) % (1 << 32)])
            draw = rng.random(fresh.shape)
            take = np.zeros_like(fresh)
            for kind in (fresh, ~fresh & (ids >= 0)):
                rank = np.argsort(np.argsort(np.where(kind, draw, 2.0), axis=1), axis=1)
                take |= kind & (rank < MEET)
            met = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take.sum(1))]), pa.int32()), pa.array(ids[take]))
            new = pa.ListArray.from_arrays(met.offsets, pa.array(fresh[take]))
            kept = [b.column(c) for c in ("vec_id", "code", "scale", "ids", "sims")]
            yield pa.RecordBatch.from_arrays([*kept, _binary(fresh & ~take), b.column("least"), met, new], names=["vec_id", "code", "scale", "ids", "sims", "fresh", "least", "met", "new"])

    told = stored(state.mapInArrow(run, STATE + ", met array<long>, new array<boolean>"))
    ways = told.select("vec_id", F.explode(F.arrays_zip("met", "new")).alias("m")).select("vec_id", F.col("m.met").alias("other"), F.col("m.new").alias("fresh"))
    # Back from a neighbour: at most MEET of each kind, drawn by hash; the limit acts before the shuffle, however many rows share a neighbour.
    draw = F.row_number().over(W.partitionBy("center", "fresh").orderBy(F.xxhash64("center", "member", F.lit(turn)), "member"))
    back = ways.select(F.col("other").alias("center"), F.col("vec_id").alias("member"), "fresh").withColumn("draw", draw).where(F.col("draw") <= MEET).drop("draw")
    return told, ways.select(F.col("vec_id").alias("center"), F.col("other").alias("member"), "fresh").unionByName(back)


def _meetings(told: DataFrame, who: DataFrame, n: int) -> DataFrame:
    """(src, dst, sim): of rows that meet, at least one of them fresh, those nearer than the other's farthest neighbour.

    A row travels once to each group that it meets others in, so groups are as few as keep the cores at work.
    """
    lots = max(1, -(-n // MEET_ROWS), min(2 * told.sparkSession.sparkContext.defaultParallelism, n // LOT_ROWS))
    there = told.select(F.col("vec_id").alias("member"), "code", "scale", "least")
    asked = who.withColumn("lot", F.pmod(F.xxhash64("center"), F.lit(lots)))
    asked = asked.groupBy("member", "lot").agg(F.collect_list("center").alias("centers"), F.collect_list("fresh").alias("news"))
    rows = asked.join(there, "member").repartition(4 * lots, "lot")

    def run(t):
        times = t["centers"].combine_chunks().value_lengths().to_numpy()
        flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        code, scale = _rows(t["code"], np.int8), t["scale"].to_numpy().astype(np.float32)
        at = np.repeat(np.arange(t.num_rows), times)
        center, fresh, member, least = flat("centers"), flat("news").astype(bool), t["member"].to_numpy()[at], t["least"].to_numpy()[at]
        order = np.lexsort((~fresh, member, center))
        center, member, fresh, least, at = center[order], member[order], fresh[order], least[order], at[order]
        once = np.ones(len(order), bool)
        once[1:] = (center[1:] != center[:-1]) | (member[1:] != member[:-1])
        center, member, fresh, least, at = center[once], member[once], fresh[once], least[once], at[once]
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]]
        cuts = np.flatnonzero(np.concatenate([[True], center[1:] != center[:-1], [True]]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            new = np.flatnonzero(fresh[i:j]) + i
            if not len(new):
                continue
            x = code[at[i:j]].astype(np.float32) * scale[at[i:j]][:, None]
            s = x[new - i] @ x.T
            s[new[:, None] == np.arange(i, j)[None]] = NOTHING
            for near, swap in ((s > least[new][:, None], False), (s > least[i:j][None], True)):
                a, b = np.nonzero(near)
                one, other = member[new[a]], member[i + b]
                for c, v in zip(out, (other, one, s[a, b]) if swap else (one, other, s[a, b]), strict=True):
                    c.append(v)
        src, dst, sim = (np.concatenate(c) for c in out)
        order = np.lexsort((dst, src))
        src, dst, sim = src[order], dst[order], sim[order]
        once = np.ones(len(src), bool)
        once[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
        return _found(src[once], dst[once], sim[once])

    return rows.groupBy("lot").applyInArrow(run, FOUND)


def _measured(df: DataFrame, state: DataFrame, n: int, k: int) -> DataFrame:
    """(src, dst, distance, rank) of the listed neighbours by the vectors as they are stored."""
    import pyarrow as pa

    kind = "<f4" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"

    def pairs(batches):
        for b in batches:
            if b.num_rows:
                ids = _rows(b.column("ids"), np.int64)[:, : 2 * k]
                src, place = np.nonzero(ids >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(b.column("vec_id").to_numpy()[src]), pa.array(ids[src, place])], names=["src", "dst"])

    listed = state.select("vec_id", "ids").mapInArrow(pairs, "src long, dst long")
    lots = max(1, n // LOT_ROWS)
    lot = lambda c: F.pmod(F.xxhash64(c), F.lit(lots)).alias("lot")
    far = listed.join(df.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("v")), "dst").select("src", "dst", "v", lot("src"))
    own = df.select(F.col("vec_id").alias("src"), F.col("embedding").alias("v"), lot("vec_id"))

    def run(left, right):
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).astype(float).reshape(t.num_rows, -1)
        ids, x = left["src"].to_numpy(), matrix(left)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        src, dst = right["src"].to_numpy(), right["dst"].to_numpy()
        y = matrix(right) if right.num_rows else np.empty((0, x.shape[1]))
        d = 1 - (x[np.searchsorted(ids, src)] * y).sum(1) / np.linalg.norm(y, axis=1)
        order = np.lexsort((dst, d, src))
        src, dst, d = src[order], dst[order], d[order]
        rank = np.arange(len(src)) - np.searchsorted(src, src) + 1
        near = rank <= k
        return pa.table({"src": src[near], "dst": dst[near], "distance": d[near], "rank": pa.array(rank[near], pa.int32())})

    return own.groupBy("lot").cogroup(far.groupBy("lot")).applyInArrow(lambda a, b: run(a, b), "src long, dst long, distance double, rank int")


def top_k_descent(df: DataFrame, k: int = 15, pool: int = POOL, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """(src, dst, distance, rank): approximately what `knn.top_k` gives for the cosine, `k` other rows for each row of `df`.

    Ids tell rows apart and aren't negative. A table of at most `leaf` rows, and rows whose list stays shorter than `k`, get theirs from
    `top_k`. Vectors without length raise an error; an empty table gives an empty one. Copies of a vector are rows like any other; of
    more equally near rows than a list holds some stand for the others. `recall` measures what is missed.
    """
    if not df.where(norm(doubles(F.col("embedding"))) == 0).limit(1).isEmpty():
        raise AnalysisError("a vector without length has no cosine distance")
    n = df.count()
    if n <= leaf:
        return top_k(df, k)
    pool *= k
    codes, found = _start(df, n, pool, leaf, seed)
    empty = [_lit(np.full((1, pool), x)) for x in (np.int64(-1), NOTHING, False)]
    blank = codes.select("*", *[F.lit(x).alias(c) for c, x in zip(("ids", "sims", "fresh"), empty, strict=True)], F.lit(float(NOTHING)).cast("float").alias("least"))
    state = stored(_merged(blank, found, n, pool))
    for turn in range(ROUNDS):
        told, who = _chosen(state, turn)
        now = stored(_merged(told.drop("met", "new"), _meetings(told, who, n), n, pool))
        for old in (state, told):
            drop_stored(old)
        state = now
        gc.collect()
        df.sparkSession._jvm.System.gc()  # a round's shuffles are of no use to the next
        if _fresh(state) < SETTLED * n * pool:
            break
    measured = stored(_measured(df, state, n, k))
    full = measured.where(F.col("rank") == min(k, n - 1)).select(F.col("src").alias("vec_id"))
    lacking = stored(df.select("vec_id").join(full, "vec_id", "left_anti"))
    drop_stored(state)
    if lacking.isEmpty():
        return measured
    return measured.join(full.withColumnRenamed("vec_id", "src"), "src", "left_semi").select("src", "dst", "distance", "rank").unionByName(top_k(df, k, sources=lacking).select("src", "dst", "distance", "rank"))


def _lit(row: np.ndarray) -> bytearray:
    return bytearray(np.ascontiguousarray(row).tobytes())


def _fresh(state: DataFrame) -> int:
    """How many listed neighbours are new."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [int(_rows(b.column("fresh"), bool).sum())]})

    return state.select("fresh").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(rows, expected, found): how many of the exact neighbours' places the approximate ones fill.

    A neighbour counts as found where it is no farther than the exact one of the last rank, so that equally near rows may stand for
    each other. Rows of `approximate` without exact neighbours don't count.
    """
    last = exact.groupBy("src").agg(F.max("distance").alias("reach"), F.count("*").alias("expected"))
    hits = approximate.join(last, "src").where(F.col("distance") <= F.col("reach") + 1e-9).groupBy("src").agg(F.count("*").alias("found"))
    both = last.join(hits, "src", "left").select("expected", F.least("expected", F.coalesce("found", F.lit(0))).alias("found"))
    return both.agg(F.count("*").alias("rows"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
