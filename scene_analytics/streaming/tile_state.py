"""Masks of a stream of tiles: the state of a tile is the sums of its pixels, whatever the number of frames.

Each tile's state is kept by its key; frames older than the watermark come too late and are left out. Every update goes to a file sink
as the sums so far, so a query that starts again from its checkpoint goes on where it was and a reader takes each tile's last sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import tiles

KEY = ["camera_id", "ty", "tx", "h", "w", "height", "width"]
SUMS = "camera_id string, ty int, tx int, h int, w int, height int, width int, n long, sums binary"
#: Places of the lead's sum and sum of squares, or of each channel's, among a mode's planes.
LEADS = {"lab": [(3, 4)], "gray": [(4, 5)], "bgr": [(0, 4), (1, 5), (2, 6)]}


def stream_tiles(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """A stream of Parquet files of tiles with the time `at` of their frames, some files at a time."""
    return spark.readStream.schema(tiles.SCHEMA + ", at timestamp").option("maxFilesPerTrigger", max_files).parquet(folder)


def running_sums(stream: DataFrame, delay: str = "10 minutes", mode: str = "lab") -> DataFrame:
    """(the tile's key, n, sums): after each batch, the sums of every tile that it had. Frames later than `delay` are left out."""
    planes = 4 + len(tiles._MORE[mode])

    def add(key, batches, state: GroupState):
        n, total = (state.get[0], np.frombuffer(state.get[1], np.int64).reshape(planes, -1)) if state.exists else (0, 0)
        for batch in batches:
            for data in batch["data"]:
                total = total + tiles._planes(np.frombuffer(bytes(data), np.uint8).reshape(-1, 3).T, mode).astype(np.int64)
                n += 1
        if n and not isinstance(total, int):
            state.update((n, total.tobytes()))
            yield pd.DataFrame([(*key, n, total.tobytes())], columns=[*KEY, "n", "sums"])

    keyed = stream.withWatermark("at", delay).groupBy(*KEY)
    return keyed.applyInPandasWithState(add, SUMS, "n long, sums binary", "append", GroupStateTimeout.EventTimeTimeout)


def write_sums(sums: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start the stream into Parquet files; with `available_now` it ends with what is there."""
    writer = sums.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each tile's last sums of those that `write_sums` wrote."""
    return spark.read.schema(SUMS).parquet(folder).groupBy(*KEY).agg(F.max("n").alias("n"), F.max_by("sums", "n").alias("sums"))


def masks_of(sums: DataFrame, threshold: float = 50.0, mode: str = "lab") -> DataFrame:
    """(camera_id, y, x, mask): 255 where the variance over all frames so far is under the threshold."""
    import pyarrow as pa

    def run(batches):
        for r in tiles.rows(batches):
            n, total = r["n"], np.frombuffer(r["sums"], np.int64).reshape(-1, r["h"] * r["w"])
            spread = sum((n * total[q] - total[s] * total[s]) / (n * n) for s, q in LEADS[mode]) / len(LEADS[mode])
            y, x = np.divmod(np.arange(r["h"] * r["w"]), r["w"])
            yield pa.RecordBatch.from_arrays([pa.array([r["camera_id"]] * len(y), pa.string()), pa.array(y + r["ty"], pa.int32()), pa.array(x + r["tx"], pa.int32()), pa.array(np.where(spread < threshold, 255, 0), pa.int32())], names=["camera_id", "y", "x", "mask"])

    return sums.mapInArrow(run, "camera_id string, y int, x int, mask int")
