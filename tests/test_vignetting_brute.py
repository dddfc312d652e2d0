"""The refined vignetting mask, step by step in plain arrays."""

import numpy as np

from scene_analytics import queries as library
from scene_analytics.operators import vignetting


def shifted(a, dy, dx, outside):
    h, w = a.shape
    out = np.full(a.shape, outside, a.dtype)
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    out[ys, xs] = a[max(0, dy) : min(h, h + dy), max(0, dx) : min(w, w + dx)]
    return out


def morph(a, k, largest):
    r = k // 2
    places = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= round((r * r - dy * dy) ** 0.5)]
    stack = [shifted(a, dy, dx, 0 if largest else 255) for dy, dx in places]
    return np.max(stack, axis=0) if largest else np.min(stack, axis=0)


def smooth(a, sigma):
    r = int(4 * sigma + 0.5)
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    w /= w.sum()
    v = a / 255
    for axis in (0, 1):
        p = np.pad(v, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
        v = np.apply_along_axis(lambda x: np.convolve(x, w, mode="valid"), axis, p)
    return np.where(v > 0.5, 255, 0)


def test_refined_mask(spark):
    pixels = library.pixels(spark, "/root/testdata/sf0.001")
    bright = vignetting.brightness_map(pixels).toPandas()
    got = vignetting.detect(pixels)[0].toPandas()
    seen = 0
    for camera, rows in bright.groupby("camera_id"):
        b = rows.pivot(index="y", columns="x", values="brightness").to_numpy()
        h, w = b.shape
        y, x = np.mgrid[:h, :w]
        d = np.hypot(y - h / 2, x - w / 2) / np.hypot(h / 2, w / 2)
        ring = np.floor(d * vignetting.BINS).astype(int)
        means = np.array([b[ring == i].mean() if (ring == i).any() else 0.0 for i in range(vignetting.BINS)])
        enough = np.flatnonzero(means >= means[:10].max() * 0.7)
        radius = (enough[-1] + 0.5) / vignetting.BINS if len(enough) else 0.5
        mask = np.where(d > radius, 255, 0)
        for largest in (True, False, False, True):
            mask = morph(mask, 15, largest)
        want = smooth(mask, 5.0)
        mine = got[got.camera_id == camera].pivot(index="y", columns="x", values="mask").to_numpy()
        assert (mine == want).all()
        seen += int(want.any())
    assert seen
