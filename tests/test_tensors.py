"""Model input against plain loops."""

import numpy as np

from scene_analytics.sources import tensors


def slow(a, size):
    h, w = a.shape[:2]
    short = min(h, w)
    to = (max(size, round(h * size / short)), max(size, round(w * size / short)))
    out = np.zeros((*to, 3))
    for y in range(to[0]):
        for x in range(to[1]):
            sy, sx = (min(max((v + 0.5) * n / t - 0.5, 0), n - 1) for v, n, t in ((y, h, to[0]), (x, w, to[1])))
            y0, x0 = int(sy), int(sx)
            for yy, fy in ((y0, 1 - (sy - y0)), (min(y0 + 1, h - 1), sy - y0)):
                for xx, fx in ((x0, 1 - (sx - x0)), (min(x0 + 1, w - 1), sx - x0)):
                    out[y, x] += a[yy, xx] * fy * fx
    top, left = (to[0] - size) // 2, (to[1] - size) // 2
    out = out[top : top + size, left : left + size]
    return np.stack([(out[:, :, 2 - c] / 255 - tensors.MEAN[c]) / tensors.STD[c] for c in range(3)])


def test_frames_and_clips(spark):
    rng = np.random.default_rng(0)
    shapes = [(9, 14, 3), (14, 9, 3), (6, 6, 3), (5, 8, 4), (7, 7, 1)]
    images = [rng.integers(0, 256, s).astype(np.uint8) for s in shapes]
    rows = [("c" if i < 3 else "d", i, *s, bytearray(a.tobytes())) for i, (s, a) in enumerate(zip(shapes, images, strict=True))] + [("d", 9, 1, 1, 3, None)]
    frames = spark.createDataFrame(rows, "clip string, slot int, height int, width int, n_channels int, data binary")
    found = tensors.prepare(frames, ["clip", "slot"], 6)
    got = {r.slot: r.tensor for r in found.collect()}
    want = [slow(np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3], 6) for a in images]
    assert got[9] is None and all(np.allclose(np.array(got[i]).reshape(3, 6, 6), w, atol=1e-5) for i, w in enumerate(want))
    clips = {r.clip: (r.frames, np.array(r.tensor)) for r in tensors.clips(found.repartition(3), 6).collect()}
    assert {k: n for k, (n, _) in clips.items()} == {"c": 3, "d": 2}
    assert np.allclose(clips["c"][1].reshape(3, 3, 6, 6), np.stack(want[:3], axis=1), atol=1e-5)
