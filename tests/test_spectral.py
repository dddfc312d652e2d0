"""Eigenvectors against a dense solver, clusters against a planted partition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_analytics.operators import spectral
from scene_analytics.plans import curation


def planted(groups=5, size=40, seed=2):
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(groups), size)
    a = np.triu(rng.random((len(of), len(of))) * (rng.random((len(of), len(of))) < np.where(of[:, None] == of, 0.4, 0.02)), 1)
    return of, a + a.T


def frame(spark, a):
    s, d = np.nonzero(a)
    return spark.createDataFrame(list(zip(s.tolist(), d.tolist(), a[s, d].tolist(), strict=True)), "src long, dst long, weight double")


@pytest.mark.parametrize("joined", [True])
def test_eigenvectors(spark, monkeypatch, joined):
    monkeypatch.setattr(spectral, "LOT_NODES", 30)
    if joined:
        monkeypatch.setattr(spectral, "BROADCAST_BYTES", 0)
    _, a = planted()
    d = np.sqrt(a.sum(1))
    n = a / d[:, None] / d
    rows, values, residual = spectral.eigenvectors(frame(spark, a), 6)
    x = np.array([np.frombuffer(r.x, float) for r in sorted(rows.collect())])
    assert np.allclose(values, np.linalg.eigvalsh(n)[::-1][:6], atol=1e-9) and residual.max() <= spectral.TOLERANCE
    assert np.allclose(x.T @ x, np.eye(6), atol=1e-9) and np.abs(n @ x - x * values).max() <= 1e-6


def test_planted_partition_and_rows_without_edges(spark):
    of, a = planted()
    a[7] = a[:, 7] = 0
    edges = frame(spark, a).unionByName(spark.createDataFrame([(300, 301, -1.0), (301, 300, -1.0)], "src long, dst long, weight double"))
    nodes = spark.range(210).withColumnRenamed("id", "vec_id")
    found = spectral.spectral(edges, 5, nodes)
    truth = spark.createDataFrame([(i, int(c)) for i, c in enumerate(of) if i != 7], "vec_id long, label int")
    assert curation.quality(found, truth).first().ari >= 0.95
    got = {r.vec_id: r.cluster_id for r in found.collect()}
    alone = [got[i] for i in (7, *range(200, 210), 300, 301)]
    assert sorted(got) == [*range(210), 300, 301] and len(set(alone)) == 13 and min(alone) > 4
    assert spectral.spectral(edges.limit(0), 2, nodes).agg(F.count_distinct("cluster_id")).first()[0] == 210


def test_curation_by_choice(spark):
    rng = np.random.default_rng(1)
    v = np.repeat(np.eye(4), 30, axis=0) + 0.05 * rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = curation.fit_predict(df, curation.ClusteringConfig(method="spectral", k_neighbors=8))
    assert found.count() == 120 and found.where("vec_id < 30").join(found.where("vec_id >= 30"), "cluster_id").isEmpty()


def test_unlike_columns_keep_their_directions():
    """A filter stretches the columns by powers of ten: before, short ones were taken for rounding and left out."""
    x = np.linalg.qr(np.random.default_rng(8).normal(size=(60, 5)))[0] * 10.0 ** np.array([9, 6, 3, 0, -2])
    found = x @ spectral._basis(x.T @ x)
    assert found.shape == (60, 5) and np.allclose(found.T @ found, np.eye(5), atol=1e-6)


def test_steps_follow_the_gap():
    near, far = np.array([1.0, 0.97, 0.8]), np.array([1.0, 0.99, 0.2])
    assert 8 < spectral._steps(near, 2, 0.95, 1e-1) <= spectral.MOST_STEPS and spectral._steps(far, 2, 0.2, 1e-5) < 8


def test_input_is_computed_once_and_vectors_travel_once_to_a_lot(spark, monkeypatch):
    """Before, the neighbours' graph was computed twice, and a vector was sent once for each edge."""
    monkeypatch.setattr(spectral, "LOT_NODES", 50)
    _, a = planted()
    edges, seen = frame(spark, a), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    scaled, d = spectral.normalized(edges.mapInArrow(counted, edges.schema))
    assert seen.value == np.count_nonzero(a)
    graph = spectral._Graph(scaled, d)
    lot = {int(i): r.lot for r in graph.nodes.collect() for i in np.frombuffer(r.ids, np.int64)}
    sent = sum(len(np.frombuffer(r["index"], np.int32)) for r in graph.parts.where("to >= 0").collect())
    pairs = {(lot[s], t) for s, t in zip(*(x.tolist() for x in np.nonzero(a)), strict=True)}
    assert len(set(lot.values())) == 4 and sent == len(pairs) < np.count_nonzero(a) / 3


def test_several_parts_and_few_nodes(spark):
    """Parts without an edge between them have an eigenvalue of one each; columns are held only where there is room."""
    a = np.kron(np.eye(4), np.ones((5, 5)) - np.eye(5))
    _, values, residual = spectral.eigenvectors(frame(spark, a), 8)
    assert np.allclose(values, [1] * 4 + [-0.25] * 4, atol=1e-9) and residual.max() <= spectral.TOLERANCE
