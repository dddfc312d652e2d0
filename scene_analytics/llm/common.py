"""What the operators of this subpackage share: tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_analytics.operators.lineage import ensure_checkpoint_dir, materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
#: A table is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `limit` rows, else unchanged. `df` should be materialised."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hash128(c: Column, name: str) -> list[Column]:
    """Two independently seeded 64-bit hashes of a column."""
    return [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit(1), c).alias(f"{name}2")]


def split_batches(batches, column: int, max_bytes: int = 4 << 20):
    """Arrow batches cut so that the texts in one piece stay near `max_bytes`; a single longer text is a piece of its own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def materialize_table(df: DataFrame) -> DataFrame:
    """As `materialize`, for large tables: written as compressed Parquet below the shared checkpoint folder and read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def remove_table(df: DataFrame) -> None:
    """Delete what `materialize_table` wrote for `df`; nothing that is still to be computed may read it. Other tables stay."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Texts are long: an Arrow batch holds few rows, and few bytes where the engine can be told so.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches that leave a worker's memory alone; smaller settings of the session stay."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        try:
            now = int(re.sub("[^0-9-]", "", str(conf.get(key))) or 0)
        except Exception:  # noqa: BLE001 - a version without this setting
            continue
        if not 0 < now <= most:
            conf.set(key, most)

    def tidied(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(tidied, schema)


def release() -> None:
    """Hand what a task has freed back to the machine: workers are used again and would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def fresh(name: str, taken) -> str:
    """`name`, with underscores behind it until no column of `taken` is called so, in whatever case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def without(columns, replaced) -> list[str]:
    """The columns whose names, in whatever case, are none of the `replaced` ones."""
    gone = {c.lower() for c in replaced}
    return [c for c in columns if c.lower() not in gone]


def carried(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns `keep` and, unless it is one of them, `text` behind them under a name of its own; and the place of the text."""
    columns = [docs[f"`{c}`"] for c in keep]
    if text in keep:
        return docs.select(*columns), keep.index(text)
    return docs.select(*columns, docs[f"`{text}`"].alias(fresh("__text", keep))), len(keep)
