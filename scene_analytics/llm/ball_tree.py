"""Exact top-k inner-product search: a ball tree on each shard, searched by branch and bound.

Vectors and queries are dealt to the nearest of a few centres and from there into shards and blocks of bounded size, so that a shard's
ball is small and a block's queries are alike. Nodes are ordered by the upper bound q.c + |q| r of the inner products below them. In
a first round each block searches one shard of its own centre; the k-th best score that a query has by then is shared. The second
round compares it with the root balls of all other shards, and only shards and nodes whose bound reaches it are opened.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialize, materialize_table, small, table

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 512, 128
#: Centres are fitted to at most so many rows, drawn by hash, and there are at most so many; a centre with more rows than a shard
#: takes has several shards. They only decide which rows lie together, never what is found.
SAMPLE_ROWS, MOST_CELLS = 2048, 64
#: Root balls are compared in lists of about so many; up to so many shards the lists are broadcast.
LIST_SHARDS, BROADCAST_SHARDS = 1024, 16_384
#: A task meets a shard with about so many blocks.
LOT_BLOCKS = 64
#: Up to this size sums of products of doubles are whole numbers without loss.
EXACT = float(2**53)


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of each query with what lies in each ball, safe against rounding."""
    with np.errstate(all="ignore"):
        size = np.sqrt((queries**2).sum(axis=1))
        slack = 1e-9 * (size[:, None] * (np.sqrt((centres**2).sum(axis=1)) + radii) + 1)
        bound = queries @ centres.T + size[:, None] * radii + slack
    return np.where(np.isnan(bound), np.inf, bound)  # beyond the doubles' range nothing is known


class BallTree:
    """Balls over the rows of a matrix of whole numbers; `order` lists the rows leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.left, self.right, self.lo, self.hi, centres, radii = [], [], [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(self.lo)
            if parent >= 0:
                (self.right if side else self.left)[parent] = me
            rows = points[self.order[lo:hi]]
            centre = rows.mean(axis=0)
            apart = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(apart.max())
            self.lo.append(lo)
            self.hi.append(hi)
            self.left.append(-1)
            self.right.append(-1)
            if hi - lo > leaf and apart.max() > 0:
                a = rows[int(apart.argmax())]
                b = rows[int(((rows - a) ** 2).sum(axis=1).argmax())]
                along = rows @ (b - a)
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argsort(along, kind="stable")]
                todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """`upper_bounds` of the queries on each node."""
        return upper_bounds(queries, self.centres, self.radii)

    def packed(self) -> dict[str, bytes]:
        return {"nodes": np.array([self.lo, self.hi, self.left, self.right], np.int64).tobytes(), "balls": np.column_stack([self.centres, self.radii]).tobytes()}

    @classmethod
    def unpacked(cls, points: np.ndarray, nodes: bytes, balls: bytes) -> BallTree:
        """The tree over points that already lie leaf by leaf."""
        tree = cls.__new__(cls)
        tree.points, tree.order = points, np.arange(len(points))
        tree.lo, tree.hi, tree.left, tree.right = np.frombuffer(nodes, np.int64).reshape(4, -1)
        tree.centres, tree.radii = tree.balls(balls, points.shape[1])
        return tree

    @staticmethod
    def balls(data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(data, np.float64).reshape(-1, dim + 1)
        return a[:, :dim], a[:, dim]

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(np.array(self.left) < 0)


def _scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as int64; beyond the doubles' range by Python's own numbers, at most what a long holds."""
    # Products of doubles are exact as long as no sum leaves their whole numbers.
    if queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) < EXACT:
        return (queries @ points.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    most = 2**63 - 1
    return np.clip(whole(queries) @ whole(points).T, -most, most).astype(np.int64)


def _narrow(points: np.ndarray) -> str:
    """The smallest kind that holds the whole numbers, for what is shuffled."""
    most = np.abs(points).max(initial=0)
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"


def search(tree: BallTree, ids: np.ndarray, rows_of: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score) of each query's k best rows in the tree that score `floor` or more, ties to smaller ids.

    The query's own row doesn't count (`rows_of`, `query_rows`: the rows' numbers). Nodes are visited level by level, leaves by
    falling bound, and each leaf serves all queries that need it.
    """
    n = len(queries)
    bound = tree.bounds(queries)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    best = np.full((n, k), np.iinfo(np.int64).min)
    floor = floor.astype(np.float64).copy()

    def open_leaf(node: int, who: np.ndarray) -> None:
        rows = tree.order[tree.lo[node] : tree.hi[node]]
        scores = _scores(queries[who], tree.points[rows])
        own = rows_of[rows][None, :] == query_rows[who][:, None]
        scores[own] = np.iinfo(np.int64).min
        all_scores = np.concatenate([best[who], scores], axis=1)
        all_ids = np.concatenate([best_id[who], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids[rows], scores.shape))], axis=1)
        order = np.lexsort((all_ids, -all_scores.astype(np.float64)), axis=1) if np.abs(all_scores[all_scores > np.iinfo(np.int64).min]).max(initial=0) < EXACT else np.lexsort((all_ids, np.where(all_scores == np.iinfo(np.int64).min, np.iinfo(np.int64).max, -all_scores)), axis=1)
        order = order[:, :k]
        best[who] = np.take_along_axis(all_scores, order, axis=1)
        best_id[who] = np.take_along_axis(all_ids, order, axis=1)
        full = best[who, k - 1] > np.iinfo(np.int64).min
        floor[who[full]] = np.maximum(floor[who[full]], best[who[full], k - 1])

    # Branch: a node below which no query can reach its floor is closed with all that lies under it.
    live, todo = [], [0]
    while todo:
        node = todo.pop()
        if (bound[:, node] >= floor).any():
            if tree.left[node] < 0:
                live.append(node)
            else:
                todo += [tree.left[node], tree.right[node]]
    # Bound: leaves in the order of their upper bounds, each for the queries that it may still serve.
    for node in sorted(live, key=lambda x: -bound[:, x].max()):
        who = np.flatnonzero(bound[:, node] >= floor)
        if len(who):
            open_leaf(node, who)
    q, r = np.nonzero(best > np.iinfo(np.int64).min)
    return q, best_id[q, r], best[q, r]


def whole_vectors(df: DataFrame, vector: str, vec_id: str, scale: float) -> DataFrame:
    """(row, vec_id, v array<double>): floor(scale * x) of each component x as double, and a number of the row.

    Vectors that take no part are left out: null ones, those with a null or (scaled) non-finite component, and those without an id.
    Repeated rows and ids stay, each a row of its own. Numbers hold once the table is written, see `materialize_table`.
    """
    v = F.col(vector)
    good = v.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(F.lit(float(scale)) * x.cast("double")) == float("inf")))

    def floor(x):  # whole already where a long could not hold it
        return F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)

    scaled = F.transform(v, lambda x: floor(F.lit(float(scale)) * x.cast("double")))
    return df.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("v"))


def fit_centres(points: np.ndarray, many: int, rounds: int = 5) -> np.ndarray:
    """At most `many` centres of rows, by a few rounds of nearest means from evenly spread different rows."""
    different = np.unique(points, axis=0)
    centres = different[np.linspace(0, len(different) - 1, min(many, len(different))).astype(int)]
    for _ in range(rounds if len(centres) > 1 else 0):
        of = nearest(points, centres)
        centres = np.array([points[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        apart = (centres**2).sum(axis=1) - 2 * points @ centres.T
    return np.where(np.isnan(apart), np.inf, apart).argmin(axis=1)


def _centres(vectors: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Centres for each length of vectors that the sample holds; none while all rows fit into a shard."""
    n = vectors.count()
    if n <= shard_rows:
        return {}
    by_dim: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("v").collect():
        by_dim.setdefault(len(r.v), []).append(r.v)
    drawn = sum(map(len, by_dim.values()))
    return {d: fit_centres(np.array(v, np.float64), min(MOST_CELLS, -(-n * len(v) // (drawn * shard_rows)))) for d, v in by_dim.items()}


def _packed(df: DataFrame, centres: dict[int, np.ndarray], rows: int, name: str, tree: bool) -> tuple[DataFrame, DataFrame]:
    """A row for each part of at most about `rows` vectors near one centre, and the number of parts of each (dim, cell).

    A part's number is its cell's and, above MOST_CELLS, its place in the cell. With `tree` its rows lie leaf by leaf.
    """
    import pyarrow as pa

    def deal(batches):
        for batch in batches:
            v, dims = batch.column(2), np.asarray(batch.column(3))
            cell = np.zeros(len(dims), np.int32)
            for d in np.unique(dims).tolist():
                if d in centres:
                    at = np.flatnonzero(dims == d)
                    cell[at] = nearest(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d), centres[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["row", "vec_id", "v", "dim", "cell"])

    def pack(key, t):
        points = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), key[0].as_py())
        ids, numbers, more = t["vec_id"].to_numpy(), t["row"].to_numpy(), {}
        if tree:
            made = BallTree(points)
            points, ids, numbers = points[made.order], ids[made.order], numbers[made.order]
            more = {f"{name}_{k}": [v] for k, v in made.packed().items()}
        points = points.astype(_narrow(points))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()), f"{name}_part": pa.array([key[1].as_py() + MOST_CELLS * key[2].as_py()], pa.int32()), f"{name}_ids": [ids.tobytes()], f"{name}_rows": [numbers.tobytes()], f"{name}_kind": [points.dtype.str], f"{name}_points": [points.tobytes()], **more})

    sized = df.select("row", "vec_id", "v", F.size("v").alias("dim"))
    dealt = arrow_map(sized, deal, "row long, vec_id long, v array<double>, dim int, cell int") if centres else sized.withColumn("cell", F.lit(0))
    counts = materialize(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(f"{name}_parts")))
    placed = dealt.join(small(counts), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("row"), F.col(f"{name}_parts")).cast("int").alias("part"), "row", "vec_id", "v")
    schema = f"dim int, cell int, {name}_part int, {name}_ids binary, {name}_rows binary, {name}_kind string, {name}_points binary"
    return materialize_table(placed.groupBy("dim", "cell", "part").applyInArrow(pack, schema + (f", {name}_nodes binary, {name}_balls binary" if tree else ""))), counts


def _matrix(r: dict, name: str) -> np.ndarray:
    return np.frombuffer(r[f"{name}_points"], r[f"{name}_kind"]).astype(np.float64).reshape(len(r[f"{name}_ids"]) // 8, r["dim"])


def _floors(r: dict) -> np.ndarray:
    floor = np.full(len(r["q_ids"]) // 8, -np.inf)
    for f in r.get("floors") or ():
        floor[f["at"]] = f["score"]
    return floor


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row of `queries` with the rows of `vectors`.

    Both have row long, vec_id long and v array<double> of whole numbers. A query's own row, the one of its number, doesn't count;
    others of its id do. Ties go to smaller ids; a query with fewer candidates has fewer rows. Vectors of unlike length don't meet;
    those without components score 0. Rows of `queries` that share an id have one list each. Empty tables give an empty one. Scores that a long can't
    hold are its ends. A task holds one shard and one block of queries at a time.
    """
    import pyarrow as pa

    centres = _centres(vectors, shard_rows)
    shards, s_counts = _packed(vectors, centres, shard_rows, "s", True)
    blocks, q_counts = _packed(queries, centres, block_rows, "q", False)
    n_shards = s_counts.agg(F.coalesce(F.sum("s_parts"), F.lit(0))).first()[0]
    n_blocks = q_counts.agg(F.coalesce(F.sum("q_parts"), F.lit(0))).first()[0]

    def find(batches):
        tree, of = None, None
        for r in _rows(batches):
            if of != (r["dim"], r["s_part"]):
                tree, of = BallTree.unpacked(_matrix(r, "s"), r["s_nodes"], r["s_balls"]), (r["dim"], r["s_part"])
            ids, numbers, q_ids, q_numbers = (np.frombuffer(r[c], np.int64) for c in ("s_ids", "s_rows", "q_ids", "q_rows"))
            floor = _floors(r)
            at, vec, score = search(tree, ids, numbers, _matrix(r, "q"), q_numbers, floor, k)
            keep = score >= floor[at]
            at, vec, score = at[keep], vec[keep], score[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["dim"]), pa.int32()), pa.array(np.full(len(at), r["q_part"]), pa.int32()), pa.array(at, pa.int32()), pa.array(q_ids[at], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["dim", "q_part", "at", "query_id", "vec_id", "score"])

    schema = "dim int, q_part int, at int, query_id long, vec_id long, score long"
    tree_columns = shards.drop("cell")
    # First, a block and one shard of its cell; a cell without shards has no floors.
    own = blocks.join(small(s_counts), ["dim", "cell"], "left").withColumn("own", F.col("cell") + MOST_CELLS * F.pmod(F.floor(F.col("q_part") / MOST_CELLS).cast("int"), F.col("s_parts"))).drop("cell", "s_parts")
    first = materialize(arrow_map(own.join(tree_columns.withColumnRenamed("s_part", "own"), ["dim", "own"]).withColumnRenamed("own", "s_part"), find, schema))
    place = W.partitionBy("dim", "q_part", "at").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k)
    floors = kth.groupBy("dim", "q_part").agg(F.collect_list(F.struct("at", "score")).alias("floors"))  # at most block_rows in a list
    asked = materialize_table(own.join(floors, ["dim", "q_part"], "left"))

    # Then the root balls of all shards, list by list, against the floors of each block.
    lists = max(1, -(-n_shards // LIST_SHARDS))
    roots = shards.select("dim", "s_part", F.expr("substring(s_balls, 1, 8 * (dim + 1))").alias("root"), F.pmod(F.xxhash64("s_part"), F.lit(lists)).cast("int").alias("list"))
    listed = roots.groupBy("dim", "list").agg(F.collect_list(F.struct("s_part", "root")).alias("roots"))
    listed = F.broadcast(listed) if n_shards <= BROADCAST_SHARDS else listed
    compared = asked.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))).join(listed, ["dim", "list"])

    def reach(batches):
        for r in _rows(batches):
            parts = np.array([x["s_part"] for x in r["roots"]], np.int32)
            c, radii = BallTree.balls(b"".join(x["root"] for x in r["roots"]), r["dim"])
            open_ = (upper_bounds(_matrix(r, "q"), c, radii) >= _floors(r)[:, None]).any(axis=0) & (parts != (-1 if r["own"] is None else r["own"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(open_.sum(), r["dim"]), pa.int32()), pa.array(parts[open_], pa.int32()), pa.array(np.full(open_.sum(), r["q_part"]), pa.int32())], names=["dim", "s_part", "q_part"])

    lots = max(1, -(-n_blocks // LOT_BLOCKS))
    pairs = materialize(arrow_map(compared, reach, "dim int, s_part int, q_part int").withColumn("lot", F.pmod(F.xxhash64("q_part"), F.lit(lots)).cast("int")))
    opened = tree_columns.join(pairs.select("dim", "s_part", "lot").distinct(), ["dim", "s_part"])
    met = pairs.join(asked.drop("own"), ["dim", "q_part"]).join(opened, ["dim", "s_part", "lot"])
    best = first.unionByName(arrow_map(met, find, schema)).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op1_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases as in `whole_vectors` and `top_k`."""
    vectors = materialize_table(whole_vectors(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 64))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLE_SQL = """
WITH good AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.row <> q.row AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
