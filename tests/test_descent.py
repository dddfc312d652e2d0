"""Neighbours by descent against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_analytics.operators import descent, knn
from scene_analytics.operators.errors import AnalysisError
from scene_analytics.plans import curation

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, v):
    return spark.createDataFrame([(i, x) for i, x in enumerate(np.asarray(v).tolist())], SCHEMA)


def measured(df, k, **more):
    found = descent.top_k_descent(df, k, **more)
    r = descent.recall(found, knn.top_k(df, k)).first()
    rows = found.collect()
    by = {}
    for x in sorted(rows, key=lambda x: x["rank"]):
        by.setdefault(x.src, []).append(x)
    assert all([x["rank"] for x in mine] == list(range(1, k + 1)) and len({x.dst for x in mine} | {src}) == k + 1 for src, mine in by.items())
    assert len(by) == df.count()
    return r.found / r.expected, by


def test_recall_on_noise_and_on_groups(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=(3000, 24))
    share, by = measured(frame(spark, noise), 10, leaf=128)
    assert share >= 0.9
    unit = noise.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert all(abs(1 - unit[x.src] @ unit[x.dst] - x.distance) < 1e-12 for mine in list(by.values())[:50] for x in mine)
    groups = np.repeat(rng.normal(size=(40, 24)), 60, axis=0) + 0.3 * rng.normal(size=(2400, 24))
    assert measured(frame(spark, groups), 10, leaf=128)[0] >= 0.9


def test_copies_are_a_third_of_all_rows(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.tile(rng.normal(size=(1, 16)), (500, 1)), rng.normal(size=(1000, 16))])
    share, by = measured(frame(spark, v), 5, leaf=64)
    assert share >= 0.9 and all(x.dst < 500 and abs(x.distance) < 1e-6 for i in range(500) for x in by[i])


def test_small_tables_are_exact(spark):
    df = frame(spark, np.random.default_rng(2).normal(size=(40, 8)))
    assert sorted(map(tuple, descent.top_k_descent(df, 4).collect())) == sorted(map(tuple, knn.top_k(df, 4).collect()))
    assert descent.top_k_descent(df.limit(0), 4).count() == 0
    with pytest.raises(AnalysisError):
        descent.top_k_descent(frame(spark, np.zeros((3, 4))))


def test_the_same_whatever_the_partitions(spark):
    df = frame(spark, np.random.default_rng(3).normal(size=(900, 12)))
    one, many = (descent.top_k_descent(d, 5, leaf=64) for d in (df.coalesce(1), df.repartition(13)))
    both = descent.recall(one, many).first()
    assert both.found >= 0.97 * both.expected


def test_curation_by_choice(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, np.repeat(np.eye(6), 120, axis=0) + 0.05 * rng.normal(size=(720, 6)))
    near, exact = (curation.build_graph(df, curation.ClusteringConfig(neighbours=c)).agg(F.count("*"), F.sum("weight")).first() for c in ("descent", "exact"))
    assert abs(near[0] / exact[0] - 1) < 0.1 and abs(near[1] / exact[1] - 1) < 0.1
    with pytest.raises(ValueError):
        curation.build_graph(df, curation.ClusteringConfig(neighbours="descent", metric="euclidean"))
