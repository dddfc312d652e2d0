"""Connected components of a link table, by alternating large-star and small-star steps, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import materialize

MAX_ROUNDS = 60


def _star(both: DataFrame, centre: DataFrame, keep) -> DataFrame:
    return both.join(centre, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.shiftright(F.xxhash64("v", "u"), 20)), F.lit(0))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v long): root is the smallest node of its component.

    Links may repeat, run both ways or join a node to itself (then it is its own component unless linked elsewhere); rows with a
    null are ignored; an empty table gives an empty table. Every step is an aggregate with map-side combining and an equi join,
    whose hot keys adaptive execution can split; each round cuts the lineage in shared storage. Raises if MAX_ROUNDS, far over the
    logarithm of any size, don't suffice.
    """
    links = links.where("u is not null and v is not null").select("u", "v")
    alone = links.where("u = v").select(F.col("u").alias("node")).distinct()
    tree = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(tree)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(_star(both, centre, F.col("v") > F.col("u")))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = materialize(hooked.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(tree)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = tree.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tree.select(F.col("v").alias("node"), F.col("v").alias("root"))).unionByName(alone.select("node", F.col("node").alias("root")))
    return found.groupBy("node").agg(F.min("root").alias("root"))
