"""Spectral clustering: leading eigenvectors of D^-1/2 A D^-1/2 by filtered subspace iteration, then k-means of their rows.

Nodes are dealt to lots; a row of a table holds a lot's vectors as one matrix. For a product with the graph each lot sends every other
one the vectors that it has edges with, each once, and adds up its own nodes' sums; inner products are small matrices, added up from one
for each task. Only these reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .community import _with_alone, canonical
from .errors import AnalysisError
from .lineage import drop_stored, stored

#: Columns beyond those asked for, steps of the filter in the first round and in any at most, and rounds at most.
MORE, STEPS, MOST_STEPS, ROUNDS = 8, 8, 48, 60
#: So many times the columns of former rounds are held, to find eigenvectors in all of them.
HELD = 3
#: Steps of one job; vectors are stored after it.
CHAIN = 12
#: A round's filter may stretch the largest eigenvalue's vector by so many powers of e more than the last one's.
STRETCH = 20.0
#: While a residual is longer, products take floats.
ROUGH = 1e-3
#: An eigenvector is found when its residual is at most so long.
TOLERANCE = 1e-6
#: Nodes of a lot at least, how many lots are wanted, and nodes from which on there are more lots.
LOT_NODES, LOTS, MOST_LOT_NODES = 2048, 24, 32768
#: Places of nodes of at most so many bytes are sent to all tasks instead of being joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Edges whose terms are added up at a time.
STRIP = 1 << 16
#: Rows that the first centres of k-means are chosen from, and its turns at most.
CENTRE_ROWS, TURNS = 4096, 30


def _matrix(column) -> np.ndarray:
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), float).reshape(len(held), -1)


def _binary(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows)]


def normalized(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, weight of D^-1/2 A D^-1/2) of the positive symmetric edges, and (vec_id, d) their nodes' square roots of strength."""
    edges = stored(edges.where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    d = stored(edges.groupBy(F.col("src").alias("vec_id")).agg(F.sqrt(F.sum("weight")).alias("d")))
    side = lambda c: d.select(F.col("vec_id").alias(c), F.col("d").alias(f"{c}_d"))
    scaled = stored(edges.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", (F.col("weight") / F.col("src_d") / F.col("dst_d")).alias("weight")))
    drop_stored(edges)
    return scaled, d


def _sums(start: np.ndarray, index: np.ndarray, weight: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each node the sum of weight * y[index] over its edges start[node] to start[node + 1], so many edges at a time."""
    total = np.zeros((len(start) - 1, y.shape[1]))
    cuts = np.unique(np.searchsorted(start, np.arange(0, start[-1], STRIP), "right") - 1)
    for a, b in zip(cuts, [*cuts[1:], len(total)], strict=True):
        held = a + np.flatnonzero(np.diff(start[a : b + 1]))
        lo, hi = start[a], start[b]
        if len(held):
            total[held] = np.add.reduceat(weight[lo:hi, None] * y[index[lo:hi]], start[held] - lo, axis=0)
    return total


class _Graph:
    """Tables by lot: `nodes` (lot, ids), `parts` (lot, to, start, index, weight). A part with `to` of -1 has the edges of the lot's
    nodes, by places among the vectors that come from all lots in order; one with another `to` the places of what that lot is sent."""

    def __init__(self, edges: DataFrame, d: DataFrame):
        import pyarrow as pa

        self.n = d.count()
        lots = max(1, min(self.n // LOT_NODES, LOTS), self.n // MOST_LOT_NODES)

        def gathered(key, t):
            return pa.table({"lot": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([np.sort(t["vec_id"].to_numpy()).tobytes()], pa.binary())})

        def placed(batches):
            for b in batches:
                for lot, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = np.frombuffer(ids, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), lot, np.int32)), pa.array(np.arange(len(ids), dtype=np.int32))], names=["vec_id", "lot", "at"])

        dealt = d.select("vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(lots)).cast("int").alias("lot"))
        self.nodes = stored(dealt.groupBy("lot").applyInArrow(gathered, "lot int, ids binary"))
        places = stored(self.nodes.mapInArrow(placed, "vec_id long, lot int, at int"))
        small = F.broadcast if self.n * 16 <= BROADCAST_BYTES else lambda t: t
        side = lambda c, *names: small(places.select(*[F.col(a).alias(b) for a, b in zip(("vec_id", "lot", "at"), (c, *names), strict=True)]))
        cells = edges.join(side("src", "lot", "at"), "src").join(side("dst", "came", "there"), "dst").select("lot", "at", "came", "there", "weight")

        def packed(key, t):
            lot, c = key[0].as_py(), {name: t[name].to_numpy() for name in t.column_names}
            sent, index = np.unique(c["came"].astype(np.int64) << 32 | c["there"], return_inverse=True)
            order = np.lexsort((index, c["at"]))
            start = np.searchsorted(c["at"][order], np.arange(int(c["at"].max()) + 2))
            came, there = sent >> 32, (sent & ((1 << 32) - 1)).astype(np.int32)
            out = [(lot, -1, start.astype(np.int64).tobytes(), index[order].astype(np.int32).tobytes(), c["weight"][order].tobytes())]
            out += [(int(f), lot, None, there[came == f].tobytes(), None) for f in np.unique(came)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.table([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["lot", "to", "start", "index", "weight"])

        self.parts = stored(cells.groupBy("lot").applyInArrow(packed, "lot int, to int, start binary, index binary, weight binary"))
        drop_stored(places)

    def _step(self, block: DataFrame, columns: int, by: tuple[float, float, float] | None, kind, send: bool) -> DataFrame:
        """(lot, came, x, before): `by` of A x, x and before, what was x is before; without `by` they stay. To `send` adds, with the
        lot that they come from, the vectors that other lots' next step takes; a lot's own row has `came` of -1."""
        import pyarrow as pa

        def run(key, left, right):
            if not left.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())], names=["lot", "came", "x", "before"])
            lot = key[0].as_py()
            rows = {r["came"]: r for r in left.to_pylist()}
            parts = {r["to"]: r for r in right.to_pylist()}
            x, before = (np.frombuffer(rows[-1][c], float).reshape(-1, columns) for c in ("x", "before"))
            if by is not None:
                new = by[1] * x + by[2] * before
                if -1 in parts:
                    start, index, weight = (np.frombuffer(parts[-1][c], t) for c, t in (("start", np.int64), ("index", np.int32), ("weight", float)))
                    y = np.concatenate([np.frombuffer(rows[c]["x"], kind).reshape(-1, columns) for c in sorted(rows) if c >= 0])
                    new[: len(start) - 1] += by[0] * _sums(start, index, weight, y)
                x, before = new, x
            out = [(lot, -1, x.tobytes(), before.tobytes())]
            if send:
                out += [(to, lot, x[np.frombuffer(p["index"], np.int32)].astype(kind).tobytes(), None) for to, p in parts.items() if to >= 0]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.table([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["lot", "came", "x", "before"])

        return block.groupBy("lot").cogroup(self.parts.groupBy("lot")).applyInArrow(lambda key, a, b: run(key, a, b), "lot int, came int, x binary, before binary")

    def steps(self, block: DataFrame, columns: int, by: list[tuple[float, float, float]], rough: bool = False) -> DataFrame:
        """(lot, x, before) after steps with these factors of A x, x and before; stored. `rough`: neighbours send floats."""
        kind, last = np.float32 if rough else float, None
        for a in range(0, len(by), CHAIN):
            some = by[a : a + CHAIN]
            rows = self._step(block.select("lot", F.lit(-1).alias("came"), "x", "before"), columns, None, kind, True)
            for i, factors in enumerate(some, 1):
                rows = self._step(rows, columns, factors, kind, i < len(some))
            block = stored(rows.select("lot", "x", "before"))
            if last is not None:
                drop_stored(last)
            last = block
        return block


def _products(block: DataFrame, widths: dict[str, int], *pairs: tuple[str, str]) -> list[np.ndarray]:
    """a.T @ b for each pair of columns of `block`: one row of sums for each task, added up on the driver's side of an aggregation."""
    import pyarrow as pa

    names = list(dict.fromkeys(c for p in pairs for c in p))

    def run(batches):
        total = None
        for b in batches:
            for r in b.to_pylist():
                m = {c: np.frombuffer(r[c], float).reshape(-1, widths[c]) for c in names}
                part = np.concatenate([(m[a].T @ m[c]).ravel() for a, c in pairs])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = block.select(*names).mapInArrow(run, "p array<double>").select(F.posexplode("p").alias("i", "x"))
    found = np.array([x for _, x in sorted((r.i, r.x) for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect())])
    ends = np.cumsum([widths[a] * widths[c] for a, c in pairs])
    return [m.reshape(widths[a], widths[c]) for m, (a, c) in zip(np.split(found, ends[:-1]), pairs, strict=True)]


def _times(block: DataFrame, widths: dict[str, int], by: dict[str, dict[str, np.ndarray]], kept: tuple[str, ...] = ()) -> DataFrame:
    """(lot, each name of `by`: the sum of columns times their matrices, and the columns `kept`); stored."""
    import pyarrow as pa

    names = list(dict.fromkeys([*(c for m in by.values() for c in m), *kept]))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                m = {c: np.frombuffer(r[c], float).reshape(-1, widths[c]) for c in names}
                out = {name: sum(m[c] @ factor for c, factor in of.items()).tobytes() for name, of in by.items()}
                yield pa.RecordBatch.from_arrays([pa.array([r["lot"]], pa.int32()), *[pa.array([v], pa.binary()) for v in (*out.values(), *(r[c] for c in kept))]], names=["lot", *by, *kept])

    return stored(block.select("lot", *names).mapInArrow(run, "lot int, " + ", ".join(f"{c} binary" for c in (*by, *kept))))


def _basis(gram: np.ndarray) -> np.ndarray:
    """A matrix that makes columns with these inner products orthonormal; directions without length are left out."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))  # the filter stretches columns unlike
    e, v = np.linalg.eigh(gram * scale * scale[:, None])
    kept = e > e[-1] * 1e-14
    return scale[:, None] * v[:, kept] / np.sqrt(e[kept])


def _steps(values: np.ndarray, k: int, low: float, worst: float) -> int:
    """How many steps of a filter that damps what is below `low` bring the residual `worst` of k vectors below TOLERANCE, as far as a round may go."""
    grow = np.arccosh(np.maximum((values[[0, k - 1]] - (low - 1) / 2) / ((low + 1) / 2), 1 + 1e-12))
    wanted = np.arccosh(max(4 * worst / TOLERANCE, 1.0)) / max(grow[1], 1e-6)
    return int(np.clip(np.ceil(wanted), 2, max(2, min(MOST_STEPS, STRETCH // max(grow[0] - grow[1], 1e-6)))))


def _apart(filtered: DataFrame, held: DataFrame | None, columns: int, width: int) -> tuple[DataFrame, int]:
    """(lot, x) of orthonormal columns, orthogonal to those of `held` too, that span with them what both span, and their number."""
    if held is None:
        block, near = filtered.select("lot", "x"), ()
    else:
        block, near = filtered.select("lot", "x").join(held.select("lot", F.col("x").alias("q")), "lot"), ("q",)
    widths, last = {"x": columns, "q": width}, None
    for turn in range(3):  # first what is in `held` goes, then columns are made orthonormal, a second time for what rounding leaves
        if held is None and not turn:
            continue
        square, *shares = _products(block, widths, ("x", "x"), *[("q", "x") for _ in near])
        if not turn:
            factor = np.diag(1 / np.sqrt(np.maximum(np.diag(square), 1e-300)))
        else:
            factor = _basis(square - sum(c.T @ c for c in shares))
        block = _times(block, widths, {"x": {"x": factor} | {"q": -c @ factor for c in shares}}, near)
        widths["x"] = factor.shape[1]
        if last is not None:
            drop_stored(last)
        last = block
    return block, widths["x"]


def eigenvectors(edges: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((vec_id, x binary: k doubles), eigenvalues, residual lengths) of the largest eigenvalues of D^-1/2 A D^-1/2, falling.

    `edges` are symmetric (src, dst, weight); weights that aren't positive don't count. k is at most the number of nodes. A round filters
    the leading columns and looks for eigenvectors in them and in those held from the rounds before. Rounds end when all k residuals are
    at most TOLERANCE; AnalysisError after ROUNDS rounds.
    """
    import pyarrow as pa

    scaled, d = normalized(edges)
    graph = _Graph(scaled, d)
    drop_stored(scaled)
    n = graph.n
    k = min(k, n)
    wide = min(n, k + MORE)
    most = min(wide * HELD, n - wide)

    def drawn(batches):
        for b in batches:
            for lot, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [np.random.default_rng([seed, int(i) % (1 << 32)]).normal(size=wide) for i in np.frombuffer(ids, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([np.array(rows).tobytes()], pa.binary())], names=["lot", "x"])

    block = stored(graph.nodes.mapInArrow(drawn, "lot int, x binary").withColumn("before", F.col("x")))
    held, width = None, 0
    low, steps, rough = 0.0, STEPS, True  # below it, eigenvalues are damped
    for _ in range(ROUNDS):
        centre, half = (low - 1) / 2, (low + 1) / 2
        filtered = graph.steps(block, wide, [(1 / half, -centre / half, 0.0), *[(2 / half, -2 * centre / half, -1.0)] * (steps - 1)], rough)
        apart, new = _apart(filtered, held, wide, width)
        image = graph.steps(apart.select("lot", "x", F.col("x").alias("before")), new, [(1.0, 0.0, 0.0)])  # x: the image, before: the vectors
        drop_stored(filtered)
        drop_stored(apart)
        whole, names, widths = image.select("lot", F.col("before").alias("x"), F.col("x").alias("y")), [("x", "y")], {"x": new, "y": new}
        if held is not None:
            whole, names = whole.join(held.select("lot", F.col("x").alias("q"), F.col("y").alias("p")), "lot"), [("q", "p"), ("x", "y")]
            widths |= {"q": width, "p": width}
        pairs = [(a, b) for a in names for b in names]
        found = _products(whole, widths, *[(a[0], b[1]) for a, b in pairs], *[(a[1], b[1]) for a, b in pairs])
        h, square = (np.block([found[i + j * len(names) : i + (j + 1) * len(names)] for j in range(len(names))]) for i in (0, len(pairs)))
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        residual = np.sqrt(np.maximum(np.diag(turn.T @ square @ turn) - values**2, 0))
        if len(values) < k:
            raise AnalysisError("fewer directions than eigenvectors asked for")
        done = residual[:k].max(initial=0.0) <= TOLERANCE
        lead = turn[:, :wide]
        drop_stored(block)
        share = lambda factor, at: {names[i][at]: m for i, m in enumerate(np.split(factor, [width] if held is not None else []))}
        if done:
            block = _times(whole, widths, {"x": share(turn[:, :k], 0)})
            break
        kept = turn[:, : max(min(most, len(values)), 0)]
        made = _times(whole, widths, {"lead": share(lead, 0), "x": share(kept, 0), "y": share(kept, 1)})
        drop_stored(image)
        if held is not None:
            drop_stored(held)
        held, width = (made, kept.shape[1]) if kept.shape[1] else (None, 0)
        wide = lead.shape[1]
        block = made.select("lot", F.col("lead").alias("x"), F.col("lead").alias("before"))
        low, worst = float(np.clip(values[min(len(values), max(kept.shape[1], wide)) - 1], -0.5, 0.999)), float(residual[:k].max())
        steps, rough = _steps(values, k, low, worst), worst > ROUGH
    else:
        raise AnalysisError("eigenvectors did not settle")

    def rows(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_binary(np.frombuffer(r["x"], float).reshape(len(ids), -1)), pa.binary())], names=["vec_id", "x"])

    return graph.nodes.join(block, "lot").mapInArrow(rows, "vec_id long, x binary"), values[:k], residual[:k]


def k_means(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(vec_id, label) of rows (vec_id, x binary of doubles) by the nearest of k centres, until no centre moves.

    First centres: of at most CENTRE_ROWS rows drawn by hash, again and again the farthest from those chosen. A turn is one sum for each task.
    """
    import pyarrow as pa

    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(CENTRE_ROWS).collect()
    x = np.array([np.frombuffer(r.x, float) for r in drawn])
    centres, far = x[:1], ((x - x[:1]) ** 2).sum(1)
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[far.argmax()]])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))

    def nearest(m):
        return ((centres**2).sum(1) - 2 * m @ centres.T).argmin(1)

    def sums(batches):
        total = np.zeros((len(centres), centres.shape[1] + 1))
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                np.add.at(total, nearest(m), np.concatenate([m, np.ones((len(m), 1))], axis=1))
        yield pa.RecordBatch.from_pydict({"p": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    for _ in range(TURNS):
        parts = rows.select("x").mapInArrow(sums, "p array<double>").select(F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        total = np.array([v for _, v in sorted((r.i, r.x) for r in parts.collect())]).reshape(len(centres), -1)
        held = total[:, -1] > 0
        new = np.where(held[:, None], total[:, :-1] / np.maximum(total[:, -1:], 1), centres)
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-9:
            break

    def label(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest(_matrix(b.column(1))).astype(np.int64))], names=["vec_id", "label"])

    return rows.select("vec_id", "x").mapInArrow(label, "vec_id long, label long")


def spectral(edges: DataFrame, k: int | None = None, nodes: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(vec_id, cluster_id): k clusters (by default the root of half the number of nodes, at least 2) by rows of k eigenvectors, each
    row brought to unit length.

    Rows of `nodes` (vec_id) and of edges that aren't positive get a cluster each behind the others. A graph without positive edges has no others.
    """
    import pyarrow as pa

    edges = stored(edges.select("src", "dst", "weight"))
    every = edges.select(F.col("src").alias("vec_id"))
    every = every if nodes is None else every.unionByName(nodes.select("vec_id"))
    positive = edges.where("weight > 0")
    if positive.isEmpty():
        return canonical(_with_alone(every.limit(0).withColumn("label", F.col("vec_id")), every))
    k = k or max(2, int((positive.select("src").distinct().count() / 2) ** 0.5))
    vectors, _, _ = eigenvectors(positive, k, seed)

    def unit(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_binary(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)), pa.binary())], names=["vec_id", "x"])

    rows = stored(vectors.mapInArrow(unit, "vec_id long, x binary"))
    return canonical(_with_alone(k_means(rows, k, seed).withColumn("label", -1 - F.col("label")), every))
