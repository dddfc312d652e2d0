"""Filters and regions over tiles give what they give on whole maps."""

import numpy as np
import pytest

from scene_analytics.operators import filters, halo, masks, regions, temporal


def table(spark, maps):
    rows = [(c, y, x, int(a[y, x])) for c, a in maps.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "camera_id string, y int, x int, mask int")


def grids(df, maps, column="mask"):
    out = {c: np.full(a.shape, -1.0) for c, a in maps.items()}
    for r in df.collect():
        out[r.camera_id][r.y, r.x] = r[column]
    return out


@pytest.fixture(scope="module")
def maps():
    rng = np.random.default_rng(0)
    spiral = np.zeros((45, 38), int)  # one long region through many tiles
    spiral[::4] = 255
    for i in range(0, 41, 4):
        spiral[i : i + 5, -1 if i // 4 % 2 == 0 else 0] = 255
    ring = np.zeros((40, 40), int)
    ring[3:37, 3:37] = 255
    ring[6:34, 6:34] = 0  # a hole across tiles
    ring[15, 15] = 255
    return {"noise": np.where(rng.random((47, 39)) < 0.45, 255, 0), "spiral": spiral, "ring": ring, "one": np.full((1, 1), 255), "none": np.zeros((9, 30), int)}


def test_regions(spark, maps):
    df = table(spark, maps)
    holes, kept = grids(regions.fill_holes(df, 8), maps), grids(regions.remove_small(df, 12, 8), maps)
    for c, a in maps.items():
        assert (holes[c] == masks.fill_holes_array(a)).all(), c
        assert (kept[c] == masks.remove_small_array(a, 12)).all(), c
    sizes = {(r.camera_id, r.area) for r in regions.areas(regions.label(df, size=8)).where("camera_id in ('spiral', 'ring', 'none')").collect()}
    assert sizes == {("spiral", int((maps["spiral"] > 0).sum())), ("ring", int((maps["ring"] > 0).sum()) - 1), ("ring", 1)}
    assert regions.fill_holes(df.limit(0)).count() == 0


def test_filters(spark, maps):
    df = table(spark, maps)
    for op, k, n, shape in (("dilate", 5, 1, "ellipse"), ("close", 5, 2, "ellipse"), ("open", 3, 2, "rect")):
        got = grids(halo.morphology(df, op, k, n, shape, 8), maps)
        assert all((got[c] == filters.morphology_array(a, op, k, n, shape)).all() for c, a in maps.items()), op
    got = grids(halo.gaussian(df, "mask", 2.0, 8), maps)
    assert all(np.allclose(got[c], filters.gaussian_array(a.astype(float), 2.0), atol=1e-9) for c, a in maps.items())


def test_refined_mask(spark, maps):
    cfg = masks.RefineConfig(min_area=30, sigma=1.5)
    got = grids(halo.refine(table(spark, maps), cfg, 16), maps)
    assert all((got[c] == masks.refine_array(a, cfg)).all() for c, a in maps.items())


def test_adaptive_mask(spark):
    rng = np.random.default_rng(3)
    a = rng.random((37, 50)) * np.linspace(5, 200, 50)
    df = spark.createDataFrame([("c", y, x, float(a[y, x])) for y in range(37) for x in range(50)], "camera_id string, y int, x int, variance double")
    cfg = temporal.TemporalConfig(block_size=8)
    got, want = (grids(df2, {"c": a})["c"] for df2 in (halo.adaptive_static_mask(df, cfg, 16), temporal.adaptive_static_mask(df, cfg)))
    assert (got == want).all() and {0, 255} == set(np.unique(got))
