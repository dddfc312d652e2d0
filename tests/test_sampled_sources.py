"""Samplers open what they sample, and decoders that can seek are told what is wanted."""

import struct

import numpy as np

from scene_analytics.operators import sampling
from scene_analytics.sources import frames, png

CALLS = "calls.txt"


def folder_of(tmp_path, n):
    folder = tmp_path / "a b+c"
    folder.mkdir()
    for i in range(n):
        data = png.png_bytes(np.full((2, 3), i % 256))
        (folder / f"f{i:05}.png").write_bytes(b"no image" if i == 7 else data)
    (folder / "note.txt").write_text("x")
    return folder


def test_only_sampled_images_are_opened(spark, tmp_path):
    folder = folder_of(tmp_path, 400)
    found = frames.sample_images(spark, str(folder), 20, "cam")
    assert len(found.inputFiles()) == 20
    want = {int(i * 20) for i in range(20)}
    assert {(r.frame_idx, r.data[0]) for r in found.collect()} == {(i, i % 256) for i in want}
    wide = frames.sample_images(spark, str(folder), 1000)
    assert wide.count() == 399 and wide.where("frame_idx = 7").isEmpty()
    one = frames.image_at(spark, str(folder), 33)
    assert one.inputFiles() == [f for f in one.inputFiles() if "f00033" in f] and [r.data[0] for r in one.collect()] == [33]
    assert frames.image_at(spark, str(folder), 400).count() == 0 and frames.image_at(spark, str(folder), 7).count() == 0
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    assert frames.sample_images(spark, str(tmp_path / "empty"), 5).count() == 0


def avi(path, n):
    head = struct.pack("<11I", 56, 40_000, 0, 0, 0, n, 0, 1, 0, 2, 2)
    path.write_bytes(b"RIFF" + bytes(4) + b"AVI LIST" + bytes(4) + b"hdrlavih" + head + bytes(range(n)))


def test_a_decoder_that_seeks_is_told_the_frames(spark, tmp_path):
    avi(tmp_path / "v.avi", 100)
    log = str(tmp_path / CALLS)

    def seeking(f, wanted):
        size = f.size()
        for i in range(100) if wanted is None else wanted:
            f.seek(size - 100 + i)
            with open(log, "a") as out:
                out.write(f"{i}\n")
            yield i, 40.0 * i, 1, 1, f.read(1) * 3

    def whole(data):
        for i in range(100):
            yield i, 40.0 * i, 1, 1, data[len(data) - 100 + i : len(data) - 99 + i] * 3

    path = str(tmp_path / "v.avi")
    want = {r.frame_idx for r in sampling.uniform_indices(spark, 100, 8).collect()}
    got = {(r.frame_idx, r.data[0]) for r in frames.sampled_source(spark, path, False, 8, seeking, "c").collect()}
    assert got == {(i, i) for i in want} and {int(x) for x in open(log)} == want
    assert {(r.frame_idx, r.data[0]) for r in frames.sampled_source(spark, path, False, 8, whole).collect()} == got
    assert frames.open_source(spark, path, False, whole).count() == 100
