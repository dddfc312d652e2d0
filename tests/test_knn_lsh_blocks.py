"""The approximate search in blocks: whole results at a size where all pairs of rows as rows of a join take too long."""

import numpy as np
from pyspark.sql import functions as F

from scene_analytics.operators import knn


def _pairs(df):
    return {(r.src, r.dst, r["rank"]) for r in df.collect()}


def test_ten_thousand_vectors(spark):
    v = np.random.default_rng(1).normal(size=(10_000, 64))
    df = spark.createDataFrame(((i, x) for i, x in enumerate(v.tolist())), "vec_id long, embedding array<float>")
    got = knn.top_k_lsh(df).select("src", "dst").collect()
    want = {(r.src, r.dst) for r in knn.top_k(df).collect()}
    assert len(got) == len(set(got)) == len(want) and len({(r.src, r.dst) for r in got} & want) >= 0.9 * len(want)


def test_only_the_rows_asked_for(spark):
    v = np.random.default_rng(2).normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    some = df.where("vec_id % 7 = 0").select("vec_id")
    got = _pairs(knn.top_k(df, 5, block_rows=64, sources=some))
    assert got == _pairs(knn.top_k(df, 5).where(F.col("src") % 7 == 0)) and len(got) == 43 * 5


def test_small_buckets_count_each_pair_once(spark):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(20, 16)), 30, axis=0) + 0.02 * rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = knn.top_k_lsh(df, 5, bucket=0.1, reach=0.3, block_rows=50).collect()
    want = {(r.src, r.dst) for r in knn.top_k(df, 5).collect()}
    assert len(got) == len({(r.src, r.dst) for r in got}) == 3000 and len({(r.src, r.dst) for r in got} & want) >= 0.9 * len(want)
