import numpy as np

from scene_analytics.operators import knn


def test_rows_without_near_neighbours_are_filled(spark):
    v = np.random.default_rng(0).normal(size=(120, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.src, r.dst) for r in knn.top_k_lsh(df, 10).collect()}
    want = {(r.src, r.dst) for r in knn.top_k(df, 10).collect()}
    assert len(got) == 1200 and len(got & want) >= 0.9 * len(want)


def test_recall_of_every_table(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        got = {(r.src, r.dst) for r in knn.top_k_lsh(df, 15).collect()}
        want = {(r.src, r.dst) for r in knn.top_k(df, 15).collect()}
        assert len(got & want) >= 0.9 * len(want), sf
