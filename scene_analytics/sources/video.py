"""What the headers and sample tables of video files say: MP4 and MOV (boxes of the movie header) and AVI. Frames aren't decoded here."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import duration
from .files import opened


def _boxes(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes between two places; only their headers are read."""
    while at + 8 <= end:
        f.seek(at)
        size, kind = struct.unpack(">I4s", f.read(8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", f.read(8))[0], 16
        size = size or end - at
        if size < head:
            raise ValueError("a box is shorter than its header")
        yield kind, at + head, min(at + size, end)
        at += size


def _inside(f, at: int, end: int, *kinds: bytes) -> tuple[int, int] | None:
    """Where the contents of the first box lie that is reached by these kinds, one inside the other."""
    for kind in kinds:
        found = next(((a, b) for k, a, b in _boxes(f, at, end) if k == kind), None)
        if found is None:
            return None
        at, end = found
    return at, end


def _read(f, at: int, form: str) -> tuple:
    f.seek(at)
    return struct.unpack(form, f.read(struct.calcsize(form)))


def _mp4(f, size: int) -> tuple[int, float, int, int]:
    movie = _inside(f, 0, size, b"moov")
    for kind, at, end in _boxes(f, *movie) if movie else ():
        if kind != b"trak":
            continue
        handler = _inside(f, at, end, b"mdia", b"hdlr")
        if handler is None or _read(f, handler[0] + 8, ">4s")[0] != b"vide":
            continue
        track, media, times = _inside(f, at, end, b"tkhd"), _inside(f, at, end, b"mdia", b"mdhd"), _inside(f, at, end, b"mdia", b"minf", b"stbl", b"stts")
        if not (track and media and times):
            continue
        width, height = (v >> 16 for v in _read(f, track[1] - 8, ">II"))
        long = _read(f, media[0], ">B")[0] == 1
        scale, lasts = _read(f, media[0] + (20 if long else 12), ">IQ" if long else ">II")
        runs = min(_read(f, times[0] + 4, ">I")[0], (times[1] - times[0] - 8) // 8)
        frames = sum(_read(f, times[0] + 8, f">{2 * runs}I")[::2])
        return frames, frames * scale / lasts if lasts else 0.0, width, height
    raise ValueError("no video track")


def _avi(f) -> tuple[int, float, int, int]:
    kind, apart, frames, width, height = _read(f, 24, "<4s4xI12xI12xII")
    if kind != b"avih":
        raise ValueError("no main header")
    return frames, 1e6 / apart if apart else 0.0, width, height


def header(f, size: int) -> tuple[int, float, int, int]:
    """(frame_count, fps, width, height) of an open file; what is neither raises ValueError."""
    start = _read(f, 0, ">12s")[0] if size >= 12 else b""
    if start[:4] == b"RIFF" and start[8:] == b"AVI ":
        return _avi(f)
    if start[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
        return _mp4(f, size)
    raise ValueError("neither MP4, MOV nor AVI")


def metadata(videos: DataFrame) -> DataFrame:
    """(path, frame_count, fps, width, height, duration, error) of videos (path); what can't be read has its error and no figures.

    Tasks read headers only, whatever the length of a file.
    """
    schema = pa.schema([("path", pa.string()), ("frame_count", pa.int64()), ("fps", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        out.append((path, *header(f, f.size()), None))
                except (OSError, ValueError, TypeError, struct.error) as e:
                    out.append((path, None, None, None, None, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    found = videos.select("path").mapInArrow(run, "path string, frame_count long, fps double, width int, height int, error string")
    return found.withColumn("duration", F.when(F.col("error").isNull(), duration(F.col("frame_count"), F.col("fps")))).select("path", "frame_count", "fps", "width", "height", "duration", "error")


def _numbers(f, at: int, form: str, count: int, end: int) -> np.ndarray:
    """`count` numbers of a numpy type from a place on, or as many as there are before `end`."""
    kind = np.dtype(form)
    f.seek(at)
    return np.frombuffer(f.read(max(0, min(count, (end - at) // kind.itemsize)) * kind.itemsize), kind).astype(np.int64)


def _mp4_samples(f, size: int) -> tuple[np.ndarray, ...]:
    """(offset, size, key frame, milliseconds) of the samples of the first video track."""
    movie = _inside(f, 0, size, b"moov")
    for kind, at, end in _boxes(f, *movie) if movie else ():
        handler = _inside(f, at, end, b"mdia", b"hdlr") if kind == b"trak" else None
        if handler is None or _read(f, handler[0] + 8, ">4s")[0] != b"vide":
            continue
        table = _inside(f, at, end, b"mdia", b"minf", b"stbl")
        media = _inside(f, at, end, b"mdia", b"mdhd")
        parts = {k: (a, b) for k, a, b in _boxes(f, *table)} if table else {}
        if not {b"stsz", b"stsc", b"stts"} <= set(parts) or media is None or not {b"stco", b"co64"} & set(parts):
            raise ValueError("a sample table is missing")
        a, b = parts[b"stsz"]
        same, count = _read(f, a + 4, ">II")
        sizes = np.full(count, same) if same else _numbers(f, a + 12, ">u4", count, b)
        wide = b"co64" in parts
        a, b = parts[b"co64" if wide else b"stco"]
        chunks = _numbers(f, a + 8, ">u8" if wide else ">u4", _read(f, a + 4, ">I")[0], b)
        a, b = parts[b"stsc"]
        runs = _numbers(f, a + 8, ">u4", 3 * _read(f, a + 4, ">I")[0], b).reshape(-1, 3)  # first chunk from 1, samples in each, description
        many = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        chunk = np.repeat(np.arange(len(many)), many)[: len(sizes)]
        if len(chunk) < len(sizes):
            raise ValueError("samples without a chunk")
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk, chunk)  # each sample's chunk's first sample
        offsets = chunks[chunk] + before - before[first]
        a, b = parts[b"stts"]
        times = _numbers(f, a + 8, ">u4", 2 * _read(f, a + 4, ">I")[0], b).reshape(-1, 2)
        lasts = np.repeat(times[:, 1], times[:, 0])[: len(sizes)]
        lasts = np.pad(lasts, (0, len(sizes) - len(lasts)), mode="edge") if len(lasts) else np.zeros(len(sizes), np.int64)
        long = _read(f, media[0], ">B")[0] == 1
        scale = _read(f, media[0] + (20 if long else 12), ">I")[0]
        keys = np.arange(len(sizes))
        if b"stss" in parts:  # without it every sample stands for itself
            a, b = parts[b"stss"]
            own = _numbers(f, a + 8, ">u4", _read(f, a + 4, ">I")[0], b) - 1
            keys = own[np.maximum(np.searchsorted(own, keys, side="right") - 1, 0)] if len(own) else np.zeros(len(sizes), np.int64)
        return offsets, sizes, keys, (np.cumsum(lasts) - lasts) * 1000.0 / scale if scale else np.zeros(len(sizes))
    raise ValueError("no video track")


def _avi_samples(f, size: int) -> tuple[np.ndarray, ...]:
    """(offset, size, key frame, milliseconds) of the first video stream's chunks, by the index at the end."""
    apart = _read(f, 32, "<I")[0]
    at, movie, index = 12, None, None
    while at + 8 <= size:
        kind, length = _read(f, at, "<4sI")
        if kind == b"LIST" and _read(f, at + 8, "<4s")[0] == b"movi":
            movie = at + 8
        elif kind == b"idx1":
            index = (at + 8, min(length, size - at - 8))
        at += 8 + length + length % 2
    if movie is None or index is None:
        raise ValueError("no index")
    f.seek(index[0])
    rows = np.frombuffer(f.read(index[1] // 16 * 16), np.dtype([("kind", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    rows = rows[np.isin(rows["kind"], [b"00dc", b"00db"])]
    # Places count from the list's type or from the file's start: the first one tells.
    from_list = len(rows) and _read(f, movie + int(rows["at"][0]), "<4s")[0] == rows["kind"][0]
    offsets = rows["at"].astype(np.int64) + (movie if from_list else 0) + 8
    own = np.flatnonzero(rows["flags"] & 0x10)
    keys = own[np.maximum(np.searchsorted(own, np.arange(len(rows)), side="right") - 1, 0)] if len(own) else np.zeros(len(rows), np.int64)
    return offsets, rows["size"].astype(np.int64), keys, np.arange(len(rows)) * apart / 1000.0


def sample_table(f, size: int) -> tuple[np.ndarray, ...]:
    """(offset, size, key frame, milliseconds) of each frame of an open file, in the order in which they are stored."""
    start = _read(f, 0, ">12s")[0] if size >= 12 else b""
    if start[:4] == b"RIFF" and start[8:] == b"AVI ":
        return _avi_samples(f, size)
    if start[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
        return _mp4_samples(f, size)
    raise ValueError("neither MP4, MOV nor AVI")


def samples(videos: DataFrame, wanted: str | None = None) -> DataFrame:
    """(path, frame_idx, offset, size, key_frame, timestamp_ms, error): where each frame of videos (path) lies in its file.

    To decode a frame, all from its key frame on are read: these byte ranges and no others. `wanted` names a column of frame numbers
    (array) to which a video is limited; null there means all, numbers that it doesn't have are left out. What can't be read is a row with its
    error. Tasks read headers, tables and indexes only.
    """
    schema = pa.schema([("path", pa.string()), ("frame_idx", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("key_frame", pa.int32()), ("timestamp_ms", pa.float64()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            asked = batch.column(1).to_pylist() if wanted else [None] * batch.num_rows
            for path, own in zip(batch.column(0).to_pylist(), asked, strict=True):
                try:
                    with opened(path) as f:
                        offset, size, key, ms = sample_table(f, f.size())
                    at = np.arange(len(offset)) if own is None else np.array(sorted({i for i in own if i is not None and 0 <= i < len(offset)}), np.int64)
                    columns = [np.full(len(at), path, object), at.astype(np.int32), offset[at], size[at], key[at].astype(np.int32), ms[at].astype(float), np.full(len(at), None)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
                except (OSError, ValueError, TypeError, struct.error) as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e) or type(e).__name__}], schema=schema)

    columns = ["path"] + ([wanted] if wanted else [])
    return videos.select(*columns).mapInArrow(run, "path string, frame_idx int, offset long, size long, key_frame int, timestamp_ms double, error string")
