"""Byte ranges of frames against files whose frames say which they are."""

import struct

import numpy as np

from scene_analytics.sources import video


def box(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def full(kind, form, *numbers):
    return box(kind, bytes(4), struct.pack(">" + form, *numbers))


def frame(i):
    return f"<{i}>".encode() * (1 + i % 5)


def mp4(n, wide=False, keys=None, even=False, first="moov"):
    """A file of `n` frames in chunks of 3 and then of 2; with `even` frames of 7 bytes."""
    frames = [f"{i:07}".encode() if even else frame(i) for i in range(n)]
    chunks, i = [], 0
    while i < n:
        many = 3 if len(chunks) < 2 else 2
        chunks.append(frames[i : i + many])
        i += many

    def movie(start):
        at, places = start, []
        for c in chunks:
            places.append(at)
            at += sum(map(len, c)) + 5  # a gap of other data
        runs = [(1, 3, 1), (3, 2, 1)] if len(chunks) > 2 else [(1, 3, 1)]
        table = [
            full(b"stts", "I" + "II" * 2, 2, 4, 100, max(n - 4, 0), 50),
            full(b"stsc", "I" + "III" * len(runs), len(runs), *[v for r in runs for v in r]),
            full(b"stsz", "II", 7, n) if even else full(b"stsz", "II" + "I" * n, 0, n, *map(len, frames)),
            full(b"co64" if wide else b"stco", "I" + ("Q" if wide else "I") * len(places), len(places), *places),
            *([] if keys is None else [full(b"stss", "I" + "I" * len(keys), len(keys), *[k + 1 for k in keys])]),
        ]
        media = box(b"mdia", full(b"mdhd", "IIIIHH", 0, 0, 1000, 50 * n, 0, 0), full(b"hdlr", "I4s12x", 0, b"vide"), box(b"minf", box(b"stbl", *table)))
        sound = box(b"trak", box(b"mdia", full(b"hdlr", "I4s12x", 0, b"soun")))
        return box(b"moov", sound, box(b"trak", media))

    head = box(b"ftyp", b"isom", bytes(4))
    data = b"".join(b"".join(c) + b"#" * 5 for c in chunks)
    if first == "moov":
        start = len(head) + len(movie(0)) + 8
        return head + movie(start) + box(b"mdat", data), frames
    return head + box(b"mdat", data) + movie(len(head) + 8), frames


def avi(n, from_list=True):
    frames = [frame(i) for i in range(n)]
    body, index, at = b"movi", b"", 4
    start = 12 + 8 + 4 + 64 + 8
    for i, x in enumerate(frames):
        sound = b"01wb" + struct.pack("<I", 4) + b"abcd"
        body += sound
        at += len(sound)
        index += b"01wb" + struct.pack("<III", 0x10, at - 12 if from_list else start + at - 12, 4)
        body += b"00dc" + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2)
        index += b"00dc" + struct.pack("<III", 0x10 if i % 4 == 0 else 0, at if from_list else start + at, len(x))
        at += 8 + len(x) + len(x) % 2
    head = b"LIST" + struct.pack("<I", 68) + b"hdrl" + b"avih" + struct.pack("<I", 56) + struct.pack("<I", 40_000) + bytes(52)
    rest = head + b"LIST" + struct.pack("<I", len(body)) + body + b"idx1" + struct.pack("<I", len(index)) + index
    return b"RIFF" + struct.pack("<I", 4 + len(rest)) + b"AVI " + rest, frames


def test_ranges_of_generated_files(spark, tmp_path):
    kinds = {"a.mp4": mp4(11, keys=[0, 4, 9]), "b.mov": mp4(4, wide=True, first="mdat"), "c.mp4": mp4(9, even=True, keys=[0]), "d.avi": avi(10), "e.avi": avi(7, False), "n.mp4": mp4(0)}
    for name, (data, _) in kinds.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "x.mp4").write_bytes(b"no video at all")
    (tmp_path / "y.avi").write_bytes(avi(3)[0][:120])
    names = [*kinds, "x.mp4", "y.avi", "gone.mp4"]
    rows = video.samples(spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")).collect()
    by = {n: sorted((r for r in rows if r.path.endswith("/" + n)), key=lambda r: r.frame_idx or 0) for n in names}
    for name, (data, frames) in kinds.items():
        assert [data[r.offset : r.offset + r.size] for r in by[name]] == frames and all(r.error is None for r in by[name]), name
    assert [r.key_frame for r in by["a.mp4"]] == [0] * 4 + [4] * 5 + [9] * 2 and [r.key_frame for r in by["b.mov"]] == [0, 1, 2, 3]
    assert [r.timestamp_ms for r in by["a.mp4"]] == [0, 100, 200, 300, *np.arange(400, 750, 50)]
    assert [r.key_frame for r in by["d.avi"]] == [i // 4 * 4 for i in range(10)] and by["d.avi"][3].timestamp_ms == 120
    assert all(len(by[n]) == 1 and by[n][0].error for n in ("x.mp4", "y.avi", "gone.mp4"))


def test_wanted_frames_only(spark, tmp_path):
    data, frames = mp4(11, keys=[0, 4, 9])
    (tmp_path / "a.mp4").write_bytes(data)
    asked = spark.createDataFrame([(str(tmp_path / "a.mp4"), [10, 5, 5, 40, -1]), (str(tmp_path / "a.mp4"), None)], "path string, frames array<int>")
    rows = video.samples(asked, "frames").collect()
    assert sorted(r.frame_idx for r in rows) == sorted([5, 10, *range(11)])
    assert all(data[r.offset : r.offset + r.size] == frames[r.frame_idx] for r in rows)
