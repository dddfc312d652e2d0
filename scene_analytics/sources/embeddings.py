"""Embeddings: encoders that can be plugged in, sinks, and a synthetic generator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize


def encode(clips: DataFrame, load_encoder: Callable[[], Callable[[list], np.ndarray]], columns: list[str], normalize: bool = True) -> DataFrame:
    """(clip columns, embedding, error) by an encoder that each worker loads once; an encoder takes the named columns of one row.

    Token matrices are averaged over tokens. A failing row has its error and no embedding; rows stay keyed, never aligned by place.
    """
    import pyarrow as pa

    names = clips.columns

    def run(batches):
        encoder = load_encoder()
        for batch in batches:
            vectors, errors = [], []
            for r in batch.to_pylist():
                try:
                    v = np.asarray(encoder([r[c] for c in columns]), np.float32)
                    vectors.append((v.mean(axis=0) if v.ndim > 1 else v).tolist())
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    vectors.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*names, "embedding", "error"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema.fields] + ["embedding array<float>", "error string"])
    out = clips.mapInArrow(run, schema)
    return out.withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>")) if normalize else out


def save(embeddings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """As Parquet, a row for each key."""
    embeddings.write.mode(mode).parquet(path)


def cluster_sizes(n: int, clusters: int, seed: int) -> list[int]:
    """How `n` rows are dealt to clusters: two tiny ones of 1 or 2, two small ones of 10 to 19, the rest evenly, the last takes what is over."""
    draw = np.random.default_rng(seed)
    wanted = np.concatenate([draw.integers(1, 3, 2), draw.integers(10, 20, 2)])[:clusters]
    wanted = np.minimum(wanted, np.maximum(n - np.cumsum(wanted) + wanted, 0))
    even = np.arange(clusters - len(wanted))
    rest = n - int(wanted.sum())
    sizes = [*wanted.tolist(), *((rest * (even + 1)) // max(len(even), 1) - (rest * even) // max(len(even), 1)).tolist()]
    sizes[-1] += n - sum(sizes)
    return sizes


def _normal(*keys):
    """A standard normal number drawn by the hash of its keys, the same wherever it is computed."""
    share = lambda salt: (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(salt)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.sqrt(-2 * F.log(share(1))) * F.cos(2 * np.pi * share(2))


def synthetic(spark: SparkSession, n: int = 500, dim: int = 1280, clusters: int = 10, noise: float = 0.3, seed: int = 42) -> DataFrame:
    """(vec_id, embedding, label): unit vectors around unit centres, sized by `cluster_sizes`, then max(5, n // 50) outliers.

    Each row is made where it is; only the clusters' sizes come from the driver.
    """
    outliers = max(5, n // 50)
    ends = np.cumsum([*cluster_sizes(n, clusters, seed), outliers]).tolist()
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    label = F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e <= F.col("vec_id")))
    rows = spark.range(n + outliers).withColumnRenamed("id", "vec_id").withColumn("label", label)
    centre = l2_normalize(F.transform(places, lambda d: _normal(F.lit(seed), F.lit("centre"), F.col("label"), d)))
    own = F.transform(places, lambda d: _normal(F.lit(seed), F.lit("row"), F.col("vec_id"), d))
    centres = F.broadcast(spark.range(clusters).select(F.col("id").cast("int").alias("label")).withColumn("centre", centre))  # a row for each cluster
    around = F.when(F.col("centre").isNull(), F.col("own")).otherwise(F.zip_with("centre", "own", lambda c, x: c + noise * x))
    made = rows.withColumn("own", own).join(centres, "label", "left")
    return made.select("vec_id", l2_normalize(around).cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label"))
