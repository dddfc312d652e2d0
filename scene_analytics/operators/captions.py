"""Captions of clusters and paths of their representatives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The scene types of the stand-in captioner, in order.
SCENE_TYPES = (
    "Rainy night on highway",
    "Dense urban traffic with pedestrians",
    "Construction zone with lane closures",
    "Parking lot navigation",
    "Highway merge with fast traffic",
    "Foggy morning on rural road",
    "School zone during dismissal",
    "Roundabout navigation",
    "Emergency vehicle approaching",
    "Cyclist in bike lane",
    "Deer crossing warning area",
    "Tunnel entrance with lighting change",
    "Snow-covered residential street",
    "Loading dock area",
    "Multi-lane intersection",
)


def scene_caption(cluster_id: Column) -> Column:
    types = F.array(*[F.lit(t) for t in SCENE_TYPES])
    return F.concat(F.lit("Cluster "), cluster_id.cast("string"), F.lit(": "), F.element_at(types, (F.pmod(cluster_id, F.lit(len(SCENE_TYPES))) + 1).cast("int")))


def caption_clusters(clusters: DataFrame, captioner: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds caption; `captioner` takes (cluster_id, path) and returns (cluster_id, caption), others get null."""
    if captioner is None:
        return clusters.withColumn("caption", scene_caption(F.col("cluster_id")))
    made = captioner(clusters.select("cluster_id", F.col("representative_path").alias("path"))).select("cluster_id", "caption")
    return clusters.join(made, "cluster_id", "left")


def representative_paths(clusters: DataFrame, fabricate: bool = True) -> DataFrame:
    """(cluster_id, path): without a path a name is made from the row's id, or the cluster is left out."""
    path = F.nullif(F.col("representative_path"), F.lit(""))
    if fabricate:
        return clusters.select("cluster_id", F.coalesce(path, F.concat(F.lit("video_"), F.col("representative_idx").cast("string"), F.lit(".mp4"))).alias("path"))
    return clusters.where("representative_path is not null").select("cluster_id", F.col("representative_path").alias("path"))


def drop_failed(clips: DataFrame, failed: DataFrame, key: str = "clip_idx") -> DataFrame:
    return clips.join(failed.select(key), key, "left_anti")


def report(info: DataFrame, edges: DataFrame, first: int = 20) -> DataFrame:
    """Lines of the text report in order: clusters by id with their flags, the first edge cases, how many more there are."""
    flag = F.concat(F.when(F.col("is_micro_cluster"), " [MICRO]").otherwise(""), F.when(F.col("is_low_density"), " [VOID]").otherwise(""))
    clusters = info.select(F.lit(0).alias("part"), F.col("cluster_id").cast("long").alias("at"), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(": "), F.col("size").cast("string"), F.lit(" rows"), flag).alias("line"))
    shown = edges.orderBy("vec_id").limit(first).select(F.lit(1).alias("part"), F.col("vec_id").alias("at"), F.concat(F.lit("Edge case "), F.col("vec_id").cast("string"), F.lit(" in cluster "), F.col("cluster_id").cast("string")).alias("line"))
    more = edges.agg((F.count("*") - first).alias("n")).where("n > 0").select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("... and "), F.col("n").cast("string"), F.lit(" more")).alias("line"))
    return clusters.unionByName(shown).unionByName(more).orderBy("part", "at")
