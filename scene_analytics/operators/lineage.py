"""Cutting lineage in storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(shared)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """`df` with `name` long, its place from 0 in the given order, which has to tell all rows apart; no task holds all rows.

    Rows are sorted by range over the tasks; a row's number is its place in its task and the sizes of the tasks before.
    """
    spark = df.sparkSession
    placed = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    task, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before, sizes = 0, []
    for r in placed.groupBy(task.alias("task")).count().orderBy("task").collect():
        sizes.append((r["task"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(sizes, "__task long, __start long"))
    return placed.join(starts, task == F.col("__task")).withColumn(name, at + F.col("__start")).drop("__at", "__task", "__start")


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, keep in reliable shared storage, cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like `materialize`, for loops: as files, whose size is known. A checkpoint keeps the planner's size, a product that grows with each turn."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that `stored` made; nothing that is still to be computed may read it. Other tables stay."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
