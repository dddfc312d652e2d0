"""Leiden communities on executors: local moves in lots of nodes, refinement within communities, aggregation, level by level.

Tables hold the graph, the labels and the way from the rows to the nodes of the present level; a task holds a lot of about LOT_NODES
nodes with their edges. Nodes of a community share a lot where they fit into one; larger communities are dealt to several by hash.
Lots and draws depend on ids only, so the result is the same whatever the partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .community import _move, _split, _with_alone, canonical, leiden_arrays
from .components import connected_components
from .lineage import drop_stored, stored

#: Nodes of a lot. A node's edges go with it.
LOT_NODES = 400
#: Turns of moves, and runs over all levels, go on while modularity rises by more.
RISE = 1e-3
#: Turns of moves at a level at most; levels and runs at most.
TURNS, LEVELS, RUNS = 12, 30, 10

EDGES = "src long, dst long, weight double"


def _hash(*columns):
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else F.lit(c) for c in columns])


def _dealt(nodes: DataFrame, by: str, lots: int) -> DataFrame:
    """`nodes` (vec_id, k, label, mass, size) with lot: by the label `by`, that of a community of more than LOT_NODES also by id."""
    parts = F.ceil(F.col("size") / LOT_NODES).cast("int")
    part = F.when(parts > 1, F.pmod(_hash("vec_id", 3), parts)).otherwise(F.lit(0))
    return nodes.withColumn("part", part.cast("int")).withColumn("lot", F.pmod(F.xxhash64(F.col(by), F.col("part")), F.lit(lots)).cast("int"))


def _weighed(labels: DataFrame) -> DataFrame:
    """labels (vec_id, k, label) with mass and size of the community."""
    sums = labels.groupBy("label").agg(F.sum("k").alias("mass"), F.count("*").alias("size"))
    return labels.join(sums, "label")


def _local(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, ids: np.ndarray):
    """(start, index, weight) of the edges between the nodes `ids`, which rise, by their places."""
    a = np.searchsorted(ids, src)
    b = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
    inner = ids[b] == dst
    a, b, w = a[inner], b[inner], weight[inner]
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    return np.searchsorted(a, np.arange(len(ids) + 1)), b, w


def _sorted(nodes, edges):
    """The columns of a lot's nodes by id and of its edges by source and target."""
    n = {c: nodes[c].to_numpy() for c in nodes.column_names}
    e = {c: edges[c].to_numpy() for c in edges.column_names}
    order, inner = np.argsort(n["vec_id"]), np.lexsort((e["dst"], e["src"]))
    return {c: v[order] for c, v in n.items()}, {c: v[inner] for c, v in e.items()}


def _walk(n: dict, e: dict, resolution: float, total: float, active: np.ndarray) -> np.ndarray:
    """Labels of a lot's nodes after its active ones moved, one after the other, to the neighbouring community of largest gain.

    Labels of other lots' nodes, and what those add to masses, are those before the turn.
    """
    ids, label, k = n["vec_id"], n["label"].copy(), n["k"]
    mass = dict(zip(n["label"].tolist(), n["mass"].tolist(), strict=True)) | dict(zip(e["label"].tolist(), e["mass"].tolist(), strict=True))
    start = np.searchsorted(e["src"], ids).tolist() + [len(e["src"])]
    at = np.minimum(np.searchsorted(ids, e["dst"]), len(ids) - 1)
    inside = np.where(ids[at] == e["dst"], at, -1).tolist()
    outer, weight, other = e["label"].tolist(), e["weight"].tolist(), (e["src"] != e["dst"]).tolist()
    label, k = label.tolist(), k.tolist()
    queue, waiting = [v for v in np.argsort(n["draw"], kind="stable").tolist() if active[v]], set(np.flatnonzero(active).tolist())
    at = 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting.discard(v)
        links: dict[int, float] = {}
        for j in range(start[v], start[v + 1]):
            if other[j]:
                c = label[inside[j]] if inside[j] >= 0 else outer[j]
                links[c] = links.get(c, 0.0) + weight[j]
        own, step = label[v], resolution * k[v] / total
        best, gain = own, links.get(own, 0.0) - step * (mass[own] - k[v]) + 1e-9
        for c, w in links.items():
            g = w - step * mass[c]
            if c != own and (g > gain + 1e-12 or (abs(g - gain) <= 1e-12 and best != own and c < best)):
                best, gain = c, g
        if best != own:
            mass[own] -= k[v]
            mass[best] += k[v]
            label[v] = best
            for j in range(start[v], start[v + 1]):
                u = inside[j]
                if u >= 0 and active[u] and u not in waiting and label[u] != best:
                    waiting.add(u)
                    queue.append(u)
    return np.array(label, np.int64)


def _around(edges: DataFrame, weighed: DataFrame, turn: int, lots: int, seed: int) -> DataFrame:
    """(here, src, dst, weight, label, mass): each lot's edges with what the other end belongs to. Of nodes that stay this turn only
    the edges inside their community count, for the modularity."""
    moves = F.lit(True) if lots == 1 else F.pmod(F.shiftright(_hash("vec_id", turn // 2, seed), 7), F.lit(2)) == turn % 2
    there = weighed.select(F.col("vec_id").alias("dst"), F.col("label").alias("of"), F.col("mass").alias("weighs"))
    where = weighed.select(F.col("vec_id").alias("src"), F.col("lot").alias("here"), F.col("label").alias("own"), moves.alias("moves"))
    met = edges.join(where, "src").join(there, "dst").where("moves or own = of")
    return met.select("here", "src", "dst", "weight", F.col("of").alias("label"), F.col("weighs").alias("mass"))


def _turn(edges: DataFrame, labels: DataFrame, turn: int, resolution: float, total: float, lots: int, seed: int) -> tuple[DataFrame, float]:
    """(labels after the moves of one turn, modularity before it).

    With several lots half of the nodes may move, the other half in the next turn; a single lot moves all of them until none gains.
    """
    import pyarrow as pa

    weighed = stored(_dealt(_weighed(labels), "label", lots))
    nodes = weighed.select("vec_id", "k", "label", "mass", "lot", _hash("vec_id", turn // 2, seed).alias("draw"))
    around = _around(edges, weighed, turn, lots, seed)

    def run(left, right):
        n, e = _sorted(left, right)
        at = np.searchsorted(n["vec_id"], e["src"])
        inside = np.bincount(at, e["weight"] * (n["label"][at] == e["label"]), len(n["vec_id"]))
        active = (n["draw"] >> np.int64(7)) % 2 == turn % 2 if lots > 1 else np.ones(len(at) and len(inside), bool)
        moved = _walk(n, e, resolution, total, active)
        return pa.table({"vec_id": n["vec_id"], "k": n["k"], "label": moved, "less": inside - resolution * n["k"] * n["mass"] / total})

    found = nodes.groupBy("lot").cogroup(around.groupBy("here")).applyInArrow(lambda a, b: run(a, b), "vec_id long, k double, label long, less double")
    new = stored(found)
    reached = new.agg(F.sum("less")).first()[0] / total
    drop_stored(weighed)
    return new, reached


def _moved(edges: DataFrame, labels: DataFrame, resolution: float, total: float, lots: int, seed: int) -> DataFrame:
    """The labels of the best turn: turns go on until two in a row, which are all nodes' turns, bring no rise."""
    if lots == 1:
        new, _ = _turn(edges, labels, 0, resolution, total, lots, seed)
        return _plain(new)
    best, kept, since, turn = -np.inf, None, 0, 0
    while since < 2 and turn < TURNS:
        new, reached = _turn(edges, labels, turn, resolution, total, lots, seed)
        since = 0 if reached > best + RISE else since + 1
        before, labels = labels, _plain(new)
        if reached > best:
            if kept is not None:
                drop_stored(kept)
            best, kept = reached, before
        else:
            drop_stored(before)
        turn += 1
    drop_stored(labels)
    return kept


def _plain(new: DataFrame) -> DataFrame:
    labels = new.drop("less")
    labels._stored_at = new._stored_at
    return labels


def _refined(edges: DataFrame, labels: DataFrame, resolution: float, total: float, lots: int, seed: int) -> DataFrame:
    """(vec_id, at, label, parts): within each community, starting from single nodes, connected groups `at` of nodes that gain together.

    Edges between communities, and those between the lots of a large community, play no part; `label` is what the group's nodes move
    as at the next level, a part of its own where the community falls apart; `parts` is how many lots the community is dealt to.
    """
    import pyarrow as pa

    weighed = stored(_dealt(_weighed(labels), "label", lots))
    nodes = weighed.select("vec_id", "k", "label", "lot", "part", F.ceil(F.col("size") / LOT_NODES).cast("int").alias("parts"))
    side = lambda c: weighed.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_of"), F.col("part").alias(f"{c}_part"), F.col("lot").alias(f"{c}_lot"))
    inner = edges.join(side("src"), "src").join(side("dst"), "dst").where("src_of = dst_of and src_part = dst_part and src <> dst")
    inner = inner.select(F.col("src_lot").alias("lot"), "src", "dst", "weight")

    def run(left, right):
        n, e = _sorted(left, right)
        ids = n["vec_id"]
        start, index, weight = _local(e["src"], e["dst"], e["weight"], ids)
        whole = np.unique(np.stack([n["label"], n["part"]]), axis=1, return_inverse=True)[1].reshape(-1)
        fine = np.arange(len(ids))
        _move(start, index, weight, n["k"], fine, resolution, total, np.random.default_rng([seed, int(ids[0]) % (1 << 32)]), within=whole)
        fine = _split(start, index, len(ids), fine)
        together = _split(start, index, len(ids), whole.copy())
        first = lambda of: ids[np.unique(of, return_index=True)[1]][of]  # noqa: E731 - the smallest id of each part
        label = np.where(n["parts"] > 1, n["label"], first(together))
        return pa.table({"vec_id": ids, "at": first(fine), "label": label, "parts": n["parts"]})

    return stored(nodes.groupBy("lot").cogroup(inner.groupBy("lot")).applyInArrow(lambda a, b: run(a, b), "vec_id long, at long, label long, parts int"))


def _contracted(edges: DataFrame, into: DataFrame) -> DataFrame:
    """The graph of the groups: weights between the same two add up, those inside become a loop."""
    side = lambda c: into.select(F.col("vec_id").alias(c), F.col("at").alias(f"{c}_at"))
    found = edges.join(side("src"), "src").join(side("dst"), "dst")
    return stored(found.groupBy(F.col("src_at").alias("src"), F.col("dst_at").alias("dst")).agg(F.sum("weight").alias("weight")))


def _finished(graph: DataFrame, labels: DataFrame, resolution: float, seed: int) -> DataFrame:
    """(vec_id, label) of a graph of at most LOT_NODES nodes after all further levels, in one group, from `labels`."""
    import pyarrow as pa

    def run(left, right):
        n, e = _sorted(left, right)
        ids = n["vec_id"]
        at = [np.searchsorted(ids, e[c]) for c in ("src", "dst")]
        of = leiden_arrays(len(ids), *at, e["weight"], resolution, seed, of=np.unique(n["label"], return_inverse=True)[1])
        return pa.table({"vec_id": ids, "label": ids[np.unique(of, return_index=True)[1]][np.unique(of, return_inverse=True)[1]]})

    nodes, edges = labels.select("vec_id", "label", F.lit(0).alias("g")), graph.select("src", "dst", "weight", F.lit(0).alias("h"))
    return nodes.groupBy("g").cogroup(edges.groupBy("h")).applyInArrow(lambda a, b: run(a, b), "vec_id long, label long")


def _strengths(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vec_id")).agg(F.sum("weight").alias("k"))


def _run(edges: DataFrame, labels: DataFrame, resolution: float, total: float, seed: int) -> tuple[DataFrame, float]:
    """(vec_id, label) and its modularity after one run over all levels from `labels` (vec_id, k, label) of the rows."""
    way, graph, count = None, edges, labels.count()
    parts = None
    for level in range(LEVELS):
        if level and count <= LOT_NODES:
            parts, into = _finished(graph, labels, resolution, seed), None
            break
        lots = max(1, -(-count // LOT_NODES))
        moved = _moved(graph, labels, resolution, total, lots, seed + level)
        into = _refined(graph, moved, resolution, total, lots, seed + level)
        fewer = into.agg(F.count_distinct("at")).first()[0]
        if fewer == count:
            break
        coarse = _contracted(graph, into)
        step = into.select(F.col("vec_id").alias("node"), "at")
        new_way = stored(into.select("vec_id", "at") if way is None else way.withColumnRenamed("at", "node").join(step, "node").select("vec_id", "at"))
        new_labels = stored(_strengths(coarse).join(into.groupBy(F.col("at").alias("vec_id")).agg(F.min("label").alias("label")), "vec_id"))
        for old in (moved, into, *([way] if way is not None else []), *([graph] if level else [])):
            drop_stored(old)
        way, graph, labels, count = new_way, coarse, new_labels, fewer
    # At the last level each group is a node; communities dealt to several lots may still fall apart.
    if parts is None:
        parts = into.select("vec_id", "label")
    if into is not None and not into.where("parts > 1").isEmpty():
        own = lambda c: into.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_of"))
        links = graph.join(own("src"), "src").join(own("dst"), "dst").where("src_of = dst_of").select(F.col("src").alias("u"), F.col("dst").alias("v"))
        found = connected_components(links.unionByName(into.select(F.col("vec_id").alias("u"), F.col("vec_id").alias("v"))))
        parts = found.select(F.col("node").alias("vec_id"), F.col("root").alias("label"))
    done = parts if way is None else way.join(parts.withColumnRenamed("vec_id", "at"), "at").select("vec_id", "label")
    done = stored(done)
    return done, modularity(edges, done, resolution).first()[0]


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of labels (vec_id, label) on symmetric edges: the share of weight inside communities less what is expected there."""
    side = lambda c: labels.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_of"))
    found = edges.join(side("src"), "src").join(side("dst"), "dst")
    each = found.groupBy(F.col("src_of").alias("label")).agg(F.sum("weight").alias("mass"), F.sum(F.when(F.col("src_of") == F.col("dst_of"), F.col("weight")).otherwise(0.0)).alias("inside"))
    total = F.sum("mass")
    return each.agg(((F.sum("inside") - resolution * F.sum(F.col("mass") * F.col("mass")) / total) / total).alias("modularity"))


def leiden(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, seed: int = 42, n_iterations: int = -1) -> DataFrame:
    """(vec_id, cluster_id) from symmetric edges (src, dst, weight); `nodes` (vec_id) adds rows without an edge, each its own cluster.

    `n_iterations` runs over all levels, each from the communities of the one before; with -1 until one brings no rise. Clusters are
    connected, numbered by falling size, then by smallest member. Edges of one pair add up. An empty graph has no clusters but `nodes`.
    """
    plain = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    edges = stored(plain.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    total = max(edges.agg(F.sum("weight")).first()[0] or 0.0, 1e-12)
    strengths = stored(_strengths(edges))
    solved, best = strengths.select("vec_id", F.col("vec_id").alias("label")), -np.inf
    for run in range(RUNS if n_iterations < 0 else n_iterations):
        if strengths.isEmpty():
            break
        began = stored(strengths.join(solved, "vec_id"))
        found, reached = _run(edges, began, resolution, total, seed + 1000 * run)
        if run and reached <= best + RISE:
            break
        solved, best = found, reached
    return canonical(_with_alone(solved, nodes))
