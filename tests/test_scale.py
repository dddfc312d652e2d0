"""Operators that number, rank and stop by group: the same results whatever the number of tasks."""

import random

import numpy as np
from pyspark.sql import functions as F

from scene_analytics.operators import community, leiden, sampling
from scene_analytics.operators.lineage import numbered
from scene_analytics.operators.percentile import exact_percentile
from scene_analytics.sources import embeddings


def test_numbers_follow_the_order(spark):
    rows = random.Random(1).sample(range(10_000), 3000)
    df = spark.createDataFrame([(i,) for i in rows], "i long").repartition(7)
    assert [(r.i, r.at) for r in numbered(df, "at", F.desc("i")).orderBy("at").collect()] == [(i, k) for k, i in enumerate(sorted(rows, reverse=True))]
    assert numbered(df.limit(0), "at", "i").count() == 0


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(3)
    for values in ([4.0], [1.0, 2.0], [5.0] * 1000, rng.normal(size=30_001).tolist(), rng.integers(0, 4, 5000).astype(float).tolist(), [0.0] * 900 + [7.0] * 100):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for q in (0.0, 0.1, 0.5, 0.95, 0.9999, 1.0):
            assert abs(exact_percentile(df, "v", q, "p").first().p - np.quantile(values, q)) < 1e-12, (len(values), q)
    assert exact_percentile(df.limit(0), "v", 0.5, "p").first().p is None


def test_each_video_ends_at_its_own_failure(spark):
    rows = [(v, i, (v, i) in {("a", 4), ("c", 0)}) for v in ("a", "b", "c", None) for i in range(8)]
    df = spark.createDataFrame(rows, "camera_id string, frame_idx int, failed boolean")
    got = {(r.camera_id, r.frame_idx) for r in sampling.strided(df, 2).collect()}
    assert got == {(v, i) for v, n in (("a", 4), ("b", 8), (None, 8)) for i in range(0, n, 2)}


def test_synthetic_rows_are_all_there(spark):
    for clusters in (1, 2, 3, 4, 5, 12):
        for n in (0, 3, 200):
            sizes = embeddings.cluster_sizes(n, clusters, 42)
            assert len(sizes) == clusters and sum(sizes) == n and min(sizes) >= 0
        rows = embeddings.synthetic(spark, n=200, dim=8, clusters=clusters).collect()
        assert sorted(r.vec_id for r in rows) == list(range(205)) and sum(r.label < clusters for r in rows) == 200
    again = {r.vec_id: r for r in embeddings.synthetic(spark, n=200, dim=8, clusters=12).repartition(7).collect()}
    assert all(list(r.embedding) == list(again[r.vec_id].embedding) for r in rows)
    v = np.array([r.embedding for r in sorted(embeddings.synthetic(spark, n=900, dim=60, clusters=5, noise=0.05).collect())])
    near = v @ v.T
    labels = np.repeat(range(6), [*embeddings.cluster_sizes(900, 5, 42), 18])
    assert near[labels == 4][:, labels == 4].min() > 0.5 and abs(near[labels == 5][:, labels == 5] - np.eye(18)).mean() < 0.15


def _graph(seed=0, groups=6, size=25):
    rng = random.Random(seed)
    n = groups * size
    edges = {(a, b) for a in range(n) for b in range(a) if rng.random() < (0.5 if a // size == b // size else 0.01)}
    return n, size, sorted(edges)


def _modularity(edges, of):
    m = len(edges)
    degree, inside = {}, 0
    for a, b in edges:
        degree[of[a]] = degree.get(of[a], 0) + 1
        degree[of[b]] = degree.get(of[b], 0) + 1
        inside += of[a] == of[b]
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def test_communities_reach_the_planted_modularity(spark):
    n, size, edges = _graph()
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges], "src long, dst long, weight double")
    planted = _modularity(edges, {i: i // size for i in range(n)})
    for solve, share in ((leiden.leiden, 0.99), (community.label_propagation, 0.8), (lambda e: community.power_iteration(e, 6), 0.5)):
        of = {r.vec_id: r.cluster_id for r in solve(df).collect()}
        assert len(of) == n and _modularity(edges, of) >= share * planted
    assert sorted(set(of.values())) == list(range(len(set(of.values()))))


def test_random_frames_are_as_many_as_there_are(spark):
    df = spark.createDataFrame([(v, i) for v in range(5) for i in range(v * 3)], "clip int, frame_idx int")
    a, b = ([tuple(r) for r in sampling.random_frames(df, 5, seed=s).collect()] for s in (1, 2))
    assert {v: sum(x[0] == v for x in a) for v in range(1, 5)} == {1: 3, 2: 5, 3: 5, 4: 5} and len(set(a)) == len(a) and a == sorted(a)
    assert a != b and a == [tuple(r) for r in sampling.random_frames(df, 5, seed=1).collect()]
