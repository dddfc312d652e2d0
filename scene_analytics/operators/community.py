"""Communities of a weighted graph: Leiden on arrays (on executors: `leiden`), label propagation and power iteration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import AnalysisError
from .lineage import drop_stored, materialize, numbered, stored

#: Rounds after which labels that still change are an error.
SETTLE_ROUNDS = 100



def modularity(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, of: np.ndarray, resolution: float = 1.0) -> float:
    """Weighted modularity with a resolution, over both directions of the edges."""
    k = np.bincount(src, w, n)
    total = w.sum()
    inside = w[of[src] == of[dst]].sum()
    return float((inside - resolution * (np.bincount(of, k) ** 2).sum() / total) / total) if total else 0.0


def _move(start, index, weight, k, of, resolution, total, rng, within=None):
    """Queued local moving; returns whether anything moved. `within`: nodes may only join communities of their own part."""
    n = len(k)
    mass = np.bincount(of, k, n)
    queue = list(rng.permutation(n))
    waiting = np.ones(n, bool)
    moved = False
    at = 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting[v] = False
        a, b = start[v], start[v + 1]
        near, w = index[a:b], weight[a:b]
        other = near != v
        near, w = near[other], w[other]
        if within is not None:
            same = within[near] == within[v]
            near, w = near[same], w[same]
        if not len(near):
            continue
        c, inverse = np.unique(of[near], return_inverse=True)
        links = np.bincount(inverse, w)
        own = of[v]
        mass[own] -= k[v]
        gain = links - resolution * k[v] * mass[c] / total
        here = gain[c == own][0] if (c == own).any() else -resolution * k[v] * mass[own] / total
        best = int(gain.argmax())
        target = int(c[best]) if gain[best] > here + 1e-12 else int(own)
        if gain.max() < -1e-12 and here < -1e-12 and within is None:
            empty = np.flatnonzero(mass == 0)
            target = int(empty[0]) if len(empty) else target
        mass[target] += k[v]
        if target != own:
            of[v] = target
            moved = True
            for u in near[of[near] != target].tolist():
                if not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    return moved


def _split(start, index, n, of):
    """Each community's connected parts get their own numbers."""
    part = np.full(n, -1)
    count = 0
    for v in range(n):
        if part[v] < 0:
            part[v], todo = count, [v]
            while todo:
                x = todo.pop()
                for u in index[start[x] : start[x + 1]].tolist():
                    if part[u] < 0 and of[u] == of[x]:
                        part[u] = count
                        todo.append(u)
            count += 1
    return part


def leiden_arrays(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 42, rounds: int = 50, of: np.ndarray | None = None) -> np.ndarray:
    """Communities of nodes 0..n-1; edges in both directions. Moves, refines inside communities, aggregates, until nothing moves.

    `of` are communities (0 to n - 1) to begin with, by default each node's own.
    """
    rng = np.random.default_rng(seed)
    node = np.arange(n)  # the current level's node of each original one
    of = np.arange(n) if of is None else np.array(of)
    for _ in range(rounds):
        m = len(of)
        order = np.argsort(src, kind="stable")
        s, index, weight = src[order], dst[order], w[order]
        start = np.searchsorted(s, np.arange(m + 1))
        k = np.bincount(s, weight, m)
        total = max(float(weight.sum()), 1e-12)
        moved = _move(start, index, weight, k, of, resolution, total, rng)
        of = _split(start, index, m, of)
        if not moved or len(np.unique(of)) == m:
            break
        fine = np.arange(m)
        _move(start, index, weight, k, fine, resolution, total, rng, within=of)
        fine = _split(start, index, m, fine)
        codes, inverse = np.unique(fine[src] * (fine.max() + 1) + fine[dst], return_inverse=True)
        w = np.bincount(inverse, w)
        src, dst = codes // (fine.max() + 1), codes % (fine.max() + 1)
        coarse = np.zeros(fine.max() + 1, int)
        coarse[fine] = of
        node, of = fine[node], np.unique(coarse, return_inverse=True)[1]
    return of[node]


def canonical(labels: DataFrame) -> DataFrame:
    """Numbers clusters by falling size, then by their smallest member."""
    labels = materialize(labels)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    ranked = numbered(sizes, "place", F.desc("n"), "first")
    return labels.join(ranked, "label").select("vec_id", F.col("place").cast("int").alias("cluster_id"))


def label_propagation(edges: DataFrame, rounds: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(vec_id, cluster_id) by heaviest neighbouring label, all on executors.

    Each round is one join and one aggregation; ties go to the smaller label. With `rounds` so many at most; without, until no label
    changes or labels go to and fro between two states, of which the first counts, and an error after SETTLE_ROUNDS. `nodes` (vec_id)
    adds rows without an edge, each its own cluster.
    """
    edges = materialize(edges.select("src", "dst", "weight"))
    labels, before = edges.select(F.col("src").alias("vec_id")).distinct().withColumn("label", F.col("vec_id")), None
    for _ in range(SETTLE_ROUNDS if rounds is None else rounds):
        votes = edges.join(labels.withColumnRenamed("vec_id", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.max(F.struct("w", (-F.col("label")).alias("less"))).alias("b"))
        new = materialize(best.select(F.col("src").alias("vec_id"), (-F.col("b.less")).alias("label")))
        same = [not old.isEmpty() and new.join(old.withColumnRenamed("label", "old"), "vec_id").where("label <> old").isEmpty() for old in (labels, before) if old is not None]
        before, labels = labels, new
        if any(same):
            break
    else:
        if rounds is None and not labels.isEmpty():
            raise AnalysisError("labels did not settle")
    return canonical(_with_alone(labels, nodes))


def _with_alone(labels: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """labels (vec_id, label) and the rows of `nodes` that have none, each under its own id."""
    if nodes is None:
        return labels
    alone = nodes.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().join(labels.select("vec_id"), "vec_id", "left_anti")
    return labels.select("vec_id", "label").unionByName(alone.withColumn("label", F.col("vec_id")))


def power_iteration(edges: DataFrame, k: int | None = None, rounds: int = 20, nodes: DataFrame | None = None) -> DataFrame:
    """(vec_id, cluster_id) by power iteration clustering; k is the root of half the number of rows by default, at least 2.

    Rows of `nodes` (vec_id) and of edges that aren't positive have no place in it: each gets a cluster of its own behind the others.
    Edges are read several times and computed once.
    """
    from pyspark.ml.clustering import PowerIterationClustering

    edges = stored(edges.select("src", "dst", "weight"))
    if k is None:
        k = max(2, int((edges.select("src").distinct().count() / 2) ** 0.5))
    once = edges.where("src < dst and weight > 0")
    found = PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight").assignClusters(once)
    labels = found.select(F.col("id").alias("vec_id"), (-1 - F.col("cluster").cast("long")).alias("label"))
    every = edges.select(F.col("src").alias("vec_id"))
    done = canonical(_with_alone(labels, every if nodes is None else every.unionByName(nodes.select("vec_id"))))
    drop_stored(edges)
    return done
