"""Both layouts of pixels give the same numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_analytics import queries as library
from scene_analytics.functions import color
from scene_analytics.operators import masks, temporal, tiles
from scene_analytics.operators.errors import AnalysisError
from scene_analytics.sources import frames


def same(a, b, columns):
    got, want = (sorted(df.select(*columns).collect()) for df in (a, b))
    assert got == want


def recording(spark, shapes, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(c, i, h, w, n, bytearray(rng.integers(0, 256, h * w * n, np.uint8).tobytes())) for i, (c, h, w, n) in enumerate(shapes)]
    return spark.createDataFrame(rows, "camera_id string, frame_idx int, height int, width int, n_channels int, data binary").repartition(3)


def test_colours_of_arrays_are_those_of_expressions(spark):
    rng = np.random.default_rng(5)
    a = np.concatenate([np.repeat(np.arange(256)[:, None], 3, 1), rng.integers(0, 256, (20_000, 3))])
    df = spark.createDataFrame([tuple(map(int, r)) for r in a], "b int, g int, r int")
    got = np.array(df.select(color.lightness(F.col("b"), F.col("g"), F.col("r")), color.gray(F.col("b"), F.col("g"), F.col("r"))).collect())
    assert (got[:, 0] == color.lightness_array(*a.T)).all() and (got[:, 1] == color.gray_array(*a.T)).all()


@pytest.mark.parametrize("size,held", [(8, 160), (5, 2), (64, 160)])
def test_layouts_agree(spark, monkeypatch, size, held):
    monkeypatch.setattr(tiles, "HELD", held)
    f = recording(spark, [("a", 17, 23, 3)] * 5 + [("b", 9, 8, 1)] * 3 + [("c", 4, 4, 4)])
    pixels, cut = frames.to_pixels(f), frames.to_tiles(f, size)
    columns = ["camera_id", "y", "x", "variance", "mean_b", "mean_g", "mean_r", "brightness", "mask", "confidence"]
    for lab in (True, False):
        cfg = temporal.TemporalConfig(use_lab=lab, variance_threshold=3000.0)
        same(tiles.analyze(cut, cfg), temporal.analyze(pixels, cfg), columns)
    same(tiles.variance(cut, "bgr"), temporal.variance(pixels, "bgr"), ["camera_id", "y", "x", "variance"])
    same(tiles.to_pixels(cut), pixels, pixels.columns)
    same(tiles.from_pixels(pixels, size), cut, cut.columns)


def test_many_frames_leave_no_sum_too_large(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ADDED", 2)
    f = recording(spark, [("a", 3, 3, 3)] * 7)
    same(tiles.variance(frames.to_tiles(f)), temporal.variance(frames.to_pixels(f)), ["camera_id", "y", "x", "variance"])


def test_no_frames_and_unlike_sizes_raise(spark):
    with pytest.raises(AnalysisError, match="no frames"):
        tiles.analyze(frames.to_tiles(recording(spark, [("a", 2, 2, 3)]).limit(0)))
    with pytest.raises(AnalysisError, match="size"):
        tiles.analyze(frames.to_tiles(recording(spark, [("a", 2, 4, 3), ("a", 4, 2, 3)])))
    with pytest.raises(ValueError):
        tiles.variance(frames.to_tiles(recording(spark, [("a", 2, 4, 3)])), "hsv")


def test_masks_of_both_layouts(spark):
    pixels = library.pixels(spark, "/root/testdata/sf0.001")
    cfg = masks.RefineConfig(min_area=50)
    want, got = masks.generate(pixels, refine_cfg=cfg), masks.generate_from(tiles.analyze(tiles.from_pixels(pixels, 16)), refine_cfg=cfg)
    for name in want:
        same(got[name], want[name], ["camera_id", "y", "x", "confidence" if name == "confidence" else "mask"])


def test_channels(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "y int, b int, g int, r int, a int")
    assert color.reorder(df).columns == ["y", "r", "g", "b", "a"] and color.reorder(df.drop("a")).columns == ["y", "r", "g", "b"]
    assert color.reorder(df.select("y")).columns == ["y"]
    with pytest.raises(ValueError):
        color.reorder(df.select("y", "b", "g"))
