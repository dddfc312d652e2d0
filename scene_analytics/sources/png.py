"""PNG files of masks, written by the tasks that hold them; read back by the engine's image source."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import store_of


def png_bytes(a: np.ndarray) -> bytes:
    """An 8-bit grey (h, w) or RGB (h, w, 3) image."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encode_masks(masks: DataFrame, column: str = "mask", key: str = "camera_id") -> DataFrame:
    """(key, png binary), an image for each key."""
    import pyarrow as pa

    def run(k, t):
        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.uint8)
        a[y, x] = t[column].to_numpy()
        return pa.table({key: pa.array([k[0].as_py()], pa.string()), "png": pa.array([png_bytes(a)], pa.binary())})

    return masks.select(F.col(key).cast("string").alias(key), F.col("y").cast("int"), F.col("x").cast("int"), F.col(column).cast("int").alias(column)).groupBy(key).applyInArrow(run, f"{key} string, png binary")


def write_masks(masks: DataFrame, folder: str, suffix: str = "mask", key: str = "camera_id") -> None:
    """{key}_{suffix}.png in a folder that all machines share, a path or the URI of a file system or object store.

    A file appears whole or not at all, so a task that is run again does no harm.
    """

    def put(rows) -> None:
        import uuid

        store, where = store_of(folder)
        store.create_dir(where, recursive=True)
        for r in rows:
            part = f"{where}/.{r[key]}_{suffix}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(bytes(r["png"]))
            store.move(part, f"{where}/{r[key]}_{suffix}.png")

    encode_masks(masks, key=key).foreachPartition(put)


def read_mask(spark: SparkSession, path: str, camera_id: str = "camera") -> DataFrame:
    """(camera_id, y, x, mask) of a grey PNG; a missing file raises."""
    from .frames import to_pixels

    image = spark.read.format("image").load(path).select(F.lit(camera_id).alias("camera_id"), F.lit(0).alias("frame_idx"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")
    return to_pixels(image).select("camera_id", "y", "x", F.col("b").alias("mask"))


def read_masks(spark: SparkSession, folder: str, suffix: str = "mask") -> DataFrame:
    """(camera_id, y, x, mask) of all that `write_masks` wrote with that suffix."""
    from .frames import to_pixels

    image = spark.read.format("image").option("pathGlobFilter", f"*_{suffix}.png").load(folder)
    name = F.regexp_extract("image.origin", f"([^/]+)_{suffix}[.]png$", 1).alias("camera_id")
    held = image.select(name, F.lit(0).alias("frame_idx"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")
    return to_pixels(held).select("camera_id", "y", "x", F.col("b").alias("mask"))
