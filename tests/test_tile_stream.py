"""A stream of tiles: restarted from its checkpoint, with late frames, its state as large as a tile."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from scene_analytics.operators import temporal, tiles
from scene_analytics.streaming import tile_state


def tiles_of(spark, first, frames, minute):
    rng = np.random.default_rng(first)
    rows = [(c, first + f, y, x, *(int(v) for v in rng.integers(0, 40 if y < 5 else 256, 3))) for c in ("a", "b") for f in range(frames) for y in range(10) for x in range(7)]
    px = spark.createDataFrame(rows, "camera_id string, frame_idx int, y int, x int, b int, g int, r int")
    at = datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)
    return px, tiles.from_pixels(px, 4).withColumn("at", F.lit(at).cast("timestamp"))


def run(spark, tmp_path):
    sums = tile_state.running_sums(tile_state.stream_tiles(spark, str(tmp_path / "in")), "10 minutes")
    tile_state.write_sums(sums, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    return tile_state.latest(spark, str(tmp_path / "out"))


def test_restart_and_late_frames(spark, tmp_path):
    parts = [tiles_of(spark, 10 * i, 3, m) for i, m in enumerate((0, 5, 60))]
    for px, t in parts[:2]:
        t.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    first = run(spark, tmp_path).collect()
    assert {r.n for r in first} == {6} and len(first) == 2 * 3 * 2
    size = {len(r.sums) for r in first}
    parts[2][1].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = run(spark, tmp_path)
    assert {r.n for r in again.collect()} == {9} and {len(r.sums) for r in again.collect()} == size
    _, late = tiles_of(spark, 90, 2, 1)  # an hour behind
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = run(spark, tmp_path)
    assert {r.n for r in found.collect()} == {9}
    px = parts[0][0].unionByName(parts[1][0]).unionByName(parts[2][0])
    want = {tuple(r) for r in temporal.static_mask(temporal.variance(px), 300.0).collect()}
    got = {tuple(r) for r in tile_state.masks_of(found, 300.0).collect()}
    assert got == want and {m for *_, m in got} == {0, 255}
