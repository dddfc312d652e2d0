"""Exact neighbours of many rows: groups' own neighbours bound what is looked at in others, and no candidate is a row that is sorted."""

import numpy as np
import pytest

from scene_analytics.operators import knn


def _brute(ids, x, other, y, k, metric):
    u, v = x.astype(float), y.astype(float)
    d = 1 - u @ v.T / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(v, axis=1) if metric == "cosine" else np.sqrt(((u[:, None] - v) ** 2).sum(2))
    d[np.isnan(d)] = np.inf
    d[ids[:, None] == other[None]] = np.inf
    return {i: sorted((round(e, 6), int(o)) for e, o in zip(row, other, strict=True) if e < np.inf)[:k] for i, row in zip(ids.tolist(), d, strict=True)}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [16, 4096])
def test_bounds_lose_no_neighbour(metric, block, monkeypatch):
    monkeypatch.setattr(knn, "PAIRS", 8)  # candidates are measured many times
    rng = np.random.default_rng(4)
    x, y = (rng.normal(size=(n, 6)).astype(np.float32) for n in (150, 130))
    x[5:25], y[50:90], y[7] = x[60], x[60], np.nan
    ids, other = np.arange(150) * 2, np.arange(130) * 2 + 1
    reach = [np.array([near[-1][0] + 1e-5 if len(near) == 4 else np.inf for near in _brute(i, z, i, z, 4, metric).values()]) for i, z in ((ids, x), (other, y))]
    one, two = knn._within(x, ids, reach[0], y, other, reach[1], 4, metric, block)
    for lists, own, u, their, v, bound in ((one, ids, x, other, y, reach[0]), (two, other, y, ids, x, reach[1])):
        got = {i: [] for i in own.tolist()}
        for s, t, d in zip(*(c.tolist() for c in lists.found(own)), strict=True):
            got[s].append((round(d, 6), t))
        want = {i: [p for p in near if p[0] <= bound[at]] for at, (i, near) in enumerate(_brute(own, u, their, v, 4, metric).items())}
        assert {i: sorted(near) for i, near in got.items()} == want


def test_what_is_no_number_takes_no_place():
    x = np.random.default_rng(1).normal(size=(30, 4)).astype(np.float32)
    x[7] = np.nan
    src, _, _ = knn._nearest(np.arange(30), x, np.arange(30), x, 3, "cosine", 64, True)
    assert np.bincount(src, minlength=30).tolist() == [3] * 7 + [0] + [3] * 22


def test_candidates_of_many_rows_are_not_sorted_as_rows(spark):
    x = np.random.default_rng(2).normal(size=(700, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = knn.top_k(df, 6, block_rows=32)
    assert "Window" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.src, {})[r.rank] = (round(r.distance, 6), r.dst)
    assert {i: [near[rank] for rank in range(1, 7)] for i, near in got.items()} == _brute(np.arange(700), x, np.arange(700), x, 6, "cosine")
