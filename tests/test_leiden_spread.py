"""Leiden on executors: whole, connected communities of at least nearly the array version's modularity, whatever the partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_analytics.operators import community, leiden
from scene_analytics.operators.components import connected_components
from scene_analytics.plans import curation
from scene_analytics.sources import embeddings


def _planted(groups=8, size=40, seed=1):
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(groups), size)
    a = np.triu(rng.random((len(of), len(of))) < np.where(of[:, None] == of, 0.4, 0.01), 1)
    s, d = np.nonzero(a | a.T)
    return len(of), s, d, of


def _frame(spark, s, d, w=None):
    w = np.ones(len(s)) if w is None else w
    return spark.createDataFrame(list(zip(s.tolist(), d.tolist(), w.tolist(), strict=True)), "src long, dst long, weight double")


def _connected(n, s, d, of):
    inner = of[s] == of[d]
    order = np.lexsort((d[inner], s[inner]))
    start = np.searchsorted(s[inner][order], np.arange(n + 1))
    return len(np.unique(community._split(start, d[inner][order], n, np.zeros(n, int)))) == len(np.unique(of))


@pytest.mark.parametrize("lot, share", [(40, 0.95)])
def test_planted_groups_in_many_lots(spark, monkeypatch, lot, share):
    monkeypatch.setattr(leiden, "LOT_NODES", lot)
    n, s, d, of = _planted()
    nodes = spark.range(n + 2).withColumnRenamed("id", "vec_id")
    edges = _frame(spark, s, d)
    labels, again = (sorted(map(tuple, leiden.leiden(e, nodes).collect())) for e in (edges, edges.orderBy(F.rand(7)).repartition(9)))
    assert labels == again and [v for v, _ in labels] == list(range(n + 2))
    found = np.array([c for _, c in labels])[:n]
    assert community.modularity(n, s, d, np.ones(len(s)), found) >= share * community.modularity(n, s, d, np.ones(len(s)), of)
    assert _connected(n, s, d, found)


def test_as_good_as_the_array_version_on_neighbours_of_noise(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(np.random.default_rng(5).normal(size=(1200, 16)).tolist())], "vec_id long, embedding array<double>")
    rows = curation.build_graph(df).collect()
    s, d, w = (np.array([r[i] for r in rows]) for i in range(3))
    found = leiden.leiden(_frame(spark, s, d, w), n_iterations=2)
    of = np.array([c for _, c in sorted(map(tuple, found.collect()))])
    order = np.lexsort((d, s))
    plain = community.leiden_arrays(1200, s[order], d[order], w[order])
    reached = community.modularity(1200, s, d, w, of)
    assert reached >= 0.99 * community.modularity(1200, s, d, w, plain) and _connected(1200, s, d, of)
    assert abs(leiden.modularity(_frame(spark, s, d, w), found.withColumnRenamed("cluster_id", "label")).first()[0] - reached) < 1e-9


def test_runs_are_counted(spark, monkeypatch):
    n, s, d, _ = _planted(4, 30)
    calls, run = [], leiden._run
    monkeypatch.setattr(leiden, "_run", lambda *a: calls.append(1) or run(*a))
    edges = _frame(spark, s, d)
    for many, least, most in ((1, 1, 1), (2, 2, 2), (-1, 2, leiden.RUNS)):
        calls.clear()
        assert leiden.leiden(edges, n_iterations=many).count() == n and least <= len(calls) <= most
    assert {r.cluster_id for r in leiden.leiden(edges, n_iterations=0).collect()} == set(range(n))


def test_edges_that_gain_nothing_and_parts_without_a_link(spark, monkeypatch):
    monkeypatch.setattr(leiden, "LOT_NODES", 4)
    rows = [(i, i + 1, -0.1) for i in range(0, 20, 2)] + [(100, 101, 1.0), (101, 102, 1.0), (200, 201, 1.0)]
    edges = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src long, dst long, weight double")
    of = {r.vec_id: r.cluster_id for r in leiden.leiden(edges).collect()}
    assert len(of) == 25 and of[100] == of[101] == of[102] != of[200] == of[201] and all(of[i] != of[i + 1] for i in range(0, 20, 2))
    none = leiden.leiden(edges.limit(0), spark.range(3).withColumnRenamed("id", "vec_id"))
    assert sorted(map(tuple, none.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10 < 9] + [(70, 70), (5, None), (90, 80)], "u long, v long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: i // 10 * 10 for i in range(50)} | {70: 70, 80: 80, 90: 80}


def test_curation_of_a_graph_in_many_lots(spark, monkeypatch):
    df = embeddings.synthetic(spark, n=400, dim=16, clusters=12, noise=0.02)
    monkeypatch.setattr(leiden, "LOT_NODES", 50)
    result = curation.run_from_embeddings(df.select("vec_id", "embedding"))
    assert result.labels.count() == df.count() and result.clusters.agg(F.sum("size")).first()[0] == df.count()
    assert curation.quality(result.labels, df.select("vec_id", "label")).first().nmi > 0.8
    assert result.captions.count() == result.clusters.count()


def test_propagation_and_power_iteration_keep_all_rows(spark):
    edges = spark.createDataFrame([(a, b, w) for x, y, w in [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.1), (8, 9, -1.0)] for a, b in ((x, y), (y, x))], "src long, dst long, weight double")
    nodes = spark.range(12).withColumnRenamed("id", "vec_id")
    for solve in (community.label_propagation, lambda e, nodes: community.power_iteration(e, 2, nodes=nodes)):
        of = {r.vec_id: r.cluster_id for r in solve(edges, nodes=nodes).collect()}
        alone = [of[i] for i in (6, 7, 10, 11)]
        assert sorted(of) == list(range(12)) and len(set(alone)) == 4 and not set(alone) & {of[i] for i in range(6)}
