import math

import duckdb
import numpy as np

from scene_analytics.llm import ball_tree as bt


def brute(rows, k, scale=64):
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for row, (q, v) in enumerate(good):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for other, (i, w) in enumerate(good) if other != row and len(w) == len(v))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).astype("f4").tolist()) for i in range(500)]
    rows += [(600 + i, rows[7][1]) for i in range(100)] + [(20, rows[20][1]), (40, rows[3][1])]  # many equal vectors; a repeated row; a repeated id
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (None, [1.0] * 8), (1080, [1.0, 2.0]), (1081, [-1e-30, 5e3]), (1100, []), (1101, [])]
    spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label string, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in bt.op1_ball_tree(spark, str(tmp_path)).collect())
    assert got == brute(rows, 20)
    assert len({r[2] for r in got if r[0] == 20} & {20}) == 1  # of its id, only the query's own row is left out
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(db.execute(f"SELECT query_id, rank, vec_id, score FROM ({bt.ORACLE_SQL})").fetchall()) == got


def test_shards_blocks_and_huge_values(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-50, 50, 5).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, (rng.integers(-3, 3, 5) * 2.0**28 + 1).tolist()) for i in range(20)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "row long, vec_id long, v array<double>")
    got = sorted(tuple(r) for r in bt.top_k(df, df.where("vec_id % 20 = 0"), 7, shard_rows=60, block_rows=5).collect())
    assert got == brute(rows, 7, 1)
    assert bt.top_k(df.limit(0), df.limit(0), 3).count() == 0


def test_scores_beyond_a_long_are_its_ends(spark):
    df = spark.createDataFrame([(0, 0, [1e200, 1.0]), (1, 1, [1e200, 0.0]), (2, 2, [-1e200, 0.0]), (3, 3, [0.0, 5.0])], "row long, vec_id long, v array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in bt.top_k(df, df.where("vec_id = 0"), 5).collect())
    assert got == [(1, 1, 2**63 - 1), (2, 3, 5), (3, 2, -(2**63) + 1)]
    assert bt.whole_vectors(spark.createDataFrame([(1, [1e308]), (2, [1.0])], "vec_id long, e array<double>"), "e", "vec_id", 64).count() == 1


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    points = np.floor(64 * (np.repeat(rng.normal(size=(16, 6)), 200, 0) + 0.01 * rng.normal(size=(3200, 6))))
    tree = bt.BallTree(points, 50)
    q = points[:40]
    scores = q @ points.T
    for node in range(len(tree.lo)):
        rows = tree.order[tree.lo[node] : tree.hi[node]]
        assert (tree.bounds(q)[:, node] >= scores[:, rows].max(axis=1)).all()
    kth = np.sort(scores, axis=1)[:, -20]
    leaves = tree.leaves()
    assert (tree.bounds(q)[:, leaves] >= kth[:, None]).mean() < 0.5


def test_packed_trees_and_far_shards(spark):
    rng = np.random.default_rng(4)
    points = np.floor(64 * rng.normal(size=(700, 3)))
    tree = bt.BallTree(points, 50)
    again = bt.BallTree.unpacked(points[tree.order], **tree.packed())
    q = points[:9]
    assert (again.bounds(q) == tree.bounds(q)).all() and again.leaves().tolist() == tree.leaves().tolist()
    assert np.isinf(bt.upper_bounds(np.array([[1e200, 0.0]]), np.array([[-1e200, 0.0]]), np.array([1e200]))).all()
    assert len(bt.fit_centres(np.zeros((40, 3)), 8)) == 1 and len(bt.fit_centres(points, 8)) == 8

    # Far groups, one with over a third of all rows; queries of a group that has no shard, too.
    centres = np.array([[900, 0, 0], [0, 900, 0], [0, 0, 900], [-900, 0, 0]])
    rows = [(i, (centres[i % 4 if i % 3 else 0] + rng.integers(-9, 9, 3)).astype(float).tolist()) for i in range(400)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "row long, vec_id long, v array<double>")
    got = sorted(tuple(r) for r in bt.top_k(df, df.where("vec_id % 20 = 0"), 5, shard_rows=30, block_rows=4).collect())
    assert got == brute(rows, 5, 1)
    other = spark.createDataFrame([(1000, 1000, [0.0, -900.0, 0.0]), (1020, 1020, [1.0])], df.schema)
    want = sorted((-sum(a * b for a, b in zip(other.first().v, v, strict=True)), i) for i, v in rows)[:5]
    assert [(r.vec_id, -r.score) for r in bt.top_k(df, other, 5, shard_rows=30).orderBy("rank").collect()] == [(i, s) for s, i in want]
