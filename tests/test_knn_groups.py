"""Neighbours by groups of blocks: exact with copies and ties, few rows leave a task; curation reads each cluster's figures from one table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_analytics.operators import knn
from scene_analytics.plans import curation


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_groups_of_blocks_give_what_brute_force_gives(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.choice([-2.0, 2.0], (300, 16))  # equal lengths and whole products: distances tie exactly
    x[100:200] = x[0]
    ids = rng.permutation(1000)[:300]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    d = 1 - x @ x.T / 64 if metric == "cosine" else np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = {(int(ids[a]), int(ids[b])) for a in range(300) for b in sorted((b for b in range(300) if b != a), key=lambda b: (round(d[a, b], 9), ids[b]))[:7]}
    got = {(r.src, r.dst) for r in knn.top_k(df, 7, metric, block_rows=16).collect()}
    assert got == want
    some = {(r.src, r.dst) for r in knn.top_k(df, 7, metric, block_rows=16, sources=df.where("vec_id % 5 = 0")).collect()}
    assert some == {(a, b) for a, b in want if a % 5 == 0}


def test_copies_leave_a_task_k_at_a_time(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert knn.candidates(df, 5, block_rows=4096).count() == 5 * 3000


def test_few_groups_are_shipped(spark):
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    assert knn.candidates(df, 3, block_rows=256).count() <= 3 * 20_000 * 6  # 79 blocks, ceil(sqrt(6 * 4 cores)) = 5 groups


def test_curation_makes_cluster_figures_once(spark):
    df = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), F.lit(1.0)).alias("embedding"), F.concat(F.lit("p"), "id").alias("path"))
    result = curation.run_from_embeddings(df)
    assert "Aggregate" not in result.clusters._jdf.queryExecution().toString() and "Aggregate" not in result.captions._jdf.queryExecution().toString()
    assert result.clusters.where("representative_path <> concat('p', representative_idx)").isEmpty()
    assert result.clusters.agg(F.sum("size")).first()[0] == 60 and result.captions.count() == result.clusters.count()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_one_product_gives_both_sides(metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 12)).astype(np.float32)
    x[5:25] = x[60]
    ids = np.sort(rng.choice(1000, 90, replace=False))
    d = 1 - x.astype(float) @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1) if metric == "cosine" else np.sqrt(((x[:, None].astype(float) - x) ** 2).sum(2))

    def want(rows, far):
        return {(int(ids[a]), int(ids[b])) for a in rows for b in sorted((b for b in far if b != a), key=lambda b: (round(d[a, b], 6), ids[b]))[:6]}

    def got(found):
        assert len(found[0]) == len(set(zip(*(c.tolist() for c in found[:2]), strict=True)))
        return set(zip(*(c.tolist() for c in found[:2]), strict=True))

    one, two = range(40), range(40, 90)
    assert got(knn._nearest(ids[:40], x[:40], ids[40:], x[40:], 6, metric, 16, True)) == want(one, two) | want(two, one)
    assert got(knn._nearest(ids, x, ids, x, 6, metric, 16, True)) == want(range(90), range(90))
    assert got(knn._nearest(ids[:40], x[:40], ids, x, 6, metric, 16)) == want(one, range(90))
