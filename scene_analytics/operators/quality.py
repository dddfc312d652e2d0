"""Agreement of two labellings: adjusted Rand index and normalised mutual information, from the contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _sums(table: DataFrame):
    rows, cols = (table.groupBy(c).agg(F.sum("n").alias("n")) for c in ("truth", "pred"))
    return rows, cols, table.agg(F.sum("n").alias("total"))


def adjusted_rand_index(table: DataFrame) -> DataFrame:
    """One row (ari); 1 where the denominator is 0."""
    rows, cols, total = _sums(table)
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    df = table.agg(pairs.alias("both")).crossJoin(rows.agg(pairs.alias("a"))).crossJoin(cols.agg(pairs.alias("b"))).crossJoin(total)
    chance = F.col("a") * F.col("b") / F.greatest(F.col("total") * (F.col("total") - 1) / 2, F.lit(1.0))
    room = (F.col("a") + F.col("b")) / 2 - chance
    return df.select(F.when(F.abs(room) < 1e-12, F.lit(1.0)).otherwise((F.col("both") - chance) / F.when(room != 0, room)).alias("ari"))


def normalized_mutual_information(table: DataFrame) -> DataFrame:
    """One row (nmi), arithmetic mean of the entropies, natural logarithms; 1 where both labellings have one class."""
    rows, cols, total = _sums(table)
    joint = table.join(rows.withColumnRenamed("n", "a"), "truth").join(cols.withColumnRenamed("n", "b"), "pred").crossJoin(total)
    info = F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b"))))
    entropy = -F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total")))
    df = joint.agg(info.alias("mi")).crossJoin(rows.crossJoin(total).agg(entropy.alias("h1"))).crossJoin(cols.crossJoin(total).agg(entropy.alias("h2")))
    h = F.col("h1") + F.col("h2")
    return df.select(F.when(h < 1e-12, F.lit(1.0)).otherwise(2 * F.col("mi") / F.when(h > 0, h)).alias("nmi"))
