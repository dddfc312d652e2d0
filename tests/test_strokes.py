"""Strokes drawn pixel by pixel give what trying every stroke at every pixel gives, and no pixel carries a mask's whole log."""

import random

from scene_analytics.operators import edits


def test_last_stroke_of_each_pixel(spark):
    rng = random.Random(6)
    log = [(m, s, rng.choice(("brush", "eraser")), *[rng.randint(-4, 16) for _ in range(4)], rng.randint(0, 7)) for m in range(3) for s in range(40)]
    log += [(0, 90, "brush", 3, 3, 3, 3, 5), (1, 91, "eraser", 2, 9, 11, 9, 4), (2, 92, "brush", 5, 1, 5, 30, 2), (7, 1, "brush", 0, 0, 9, 9, 3)]
    blank = spark.createDataFrame([(m, y, x, 0) for m in range(4) for y in range(9) for x in range(13)], "mask_id int, y int, x int, mask int")
    drawn = edits.apply_edits(blank, spark.createDataFrame(log, "mask_id int, seq int, op string, x1 int, y1 int, x2 int, y2 int, size int"))
    assert "collect_list" not in drawn._jdf.queryExecution().executedPlan().toString()
    want = {(m, y, x): 0 for m in range(4) for y in range(9) for x in range(13)}
    for m, _, op, x1, y1, x2, y2, size in sorted(log, key=lambda r: r[:2]):
        for y in range(9):
            for x in range(13):
                dx, dy = x2 - x1, y2 - y1
                t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                if (x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2 <= (size // 2) ** 2 and m < 4:
                    want[m, y, x] = 255 if op == "brush" else 0
    assert {(r.mask_id, r.y, r.x): r.mask for r in drawn.collect()} == want
