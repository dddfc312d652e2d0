"""Work that grows with the pairs: how often edges are computed, and how many pairs are measured in doubles."""

import numpy as np

from scene_analytics.operators import community, knn


def _brute(ids, x, other, y, k):
    u, v = (z.astype(float) / np.linalg.norm(z.astype(float), axis=1)[:, None] for z in (x, y))
    d = 1 - u @ v.T
    d[ids[:, None] == other[None]] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(int(i), int(other[j])) for i, row in zip(ids, near, strict=True) for j in row}


def test_power_iteration_computes_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = [(a, b) for a in range(12) for b in range(12) if a != b and a // 6 == b // 6] + [(0, 6), (6, 0)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double").mapInArrow(count, "src long, dst long, weight double")
    found = community.power_iteration(edges, 2)
    assert found.count() == 12 and seen.value == len(pairs)


def test_few_pairs_are_measured_in_doubles(monkeypatch):
    rng = np.random.default_rng(3)
    n, k = 2000, 5
    ids, other = np.arange(n) * 2, np.arange(n) * 3
    x, y = (rng.normal(size=(n, 8)).astype(np.float32) for _ in range(2))
    measured, exact = [], knn._exact
    monkeypatch.setattr(knn, "_exact", lambda x, y, a, b, *rest: measured.append(len(a)) or exact(x, y, a, b, *rest))
    src, dst, _ = knn._nearest(ids, x, other, y, k, "cosine", 128, True)
    pairs = list(zip(src.tolist(), dst.tolist(), strict=True))
    assert sum(measured) <= 1.5 * k * 2 * n
    assert set(pairs[: n * k]) == _brute(ids, x, other, y, k) and set(pairs[n * k :]) == _brute(other, y, ids, x, k)


def test_copies_and_entries_without_number():
    x = np.ones((300, 4), np.float32)
    x[7] = np.nan
    src, dst, d = knn._nearest(np.arange(300), x, np.arange(300), x, 3, "cosine", 16, True)
    assert 7 not in src and 7 not in dst and np.allclose(d, 0)
    for i, near in ((0, [1, 2, 3]), (9, [0, 1, 2])):
        assert sorted(dst[src == i].tolist()) == near
