"""Exact percentiles without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Of the sketch that finds the neighbourhood: an error of one rank in so many, a bounded size for each task.
ACCURACY = 10_000


def exact_percentile(df: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """One row with `name` double: the value at rank q * (n - 1), interpolated linearly; null if there is no value.

    A sketch gives two values that surely enclose the rank, but for one place. Only the few thousandths of rows between them are
    counted by value and put in order; of those below only the number and the largest are needed, of those above the smallest. Null
    values don't count.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    margin = 2.0 / ACCURACY
    sketch = F.percentile_approx("v", [max(q - margin, 0.0), min(q + margin, 1.0)], ACCURACY)
    enclosed = F.broadcast(values.agg(F.count("*").alias("n"), F.get(sketch, F.lit(0)).alias("low"), F.get(sketch, F.lit(1)).alias("high")))
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    counted = values.crossJoin(enclosed).groupBy(side.alias("side"), F.when(side == 0, F.col("v")).alias("at")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("n").alias("n"))
    placed = counted.withColumn("upto", F.sum("c").over(W.orderBy("side", "at")))
    rank = F.lit(q) * (F.col("n") - 1)
    value = F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least"))
    at = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r), value))
    found = placed.agg(at(F.floor(rank)).alias("a"), at(F.ceil(rank)).alias("b"), F.max(rank - F.floor(rank)).alias("part"))
    return found.select((F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias(name))
