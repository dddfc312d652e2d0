"""Cluster statistics on (vec_id, embedding, cluster_id): centroids, densities, representatives, edge cases, voids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance, doubles, norm, scale
from .errors import AnalysisError
from .percentile import exact_percentile

EPS = 1e-8


@dataclass(frozen=True)
class AnalysisConfig:
    micro_cluster_threshold: int = 3
    low_density_percentile: float = 10.0
    outlier_distance_percentile: float = 95.0


def sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster_id").agg(F.count("*").alias("size"))


def distinct_clusters(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("cluster_id").alias("n_clusters"))


def centroids(df: DataFrame) -> DataFrame:
    """(cluster_id, centroid): the mean of each cluster, divided by its length; one partial sum per task and cluster."""
    mean = df.groupBy("cluster_id").agg(vector_to_array(Summarizer.mean(array_to_vector(doubles(F.col("embedding"))))).alias("mean"))
    return mean.select("cluster_id", scale(F.col("mean"), norm(F.col("mean")) + EPS).alias("centroid"))


def distances(df: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    """(vec_id, cluster_id, dist) to the own centroid."""
    centres = centroids(df) if centres is None else centres
    return df.join(centres, "cluster_id").select("vec_id", "cluster_id", distance(doubles(F.col("embedding")), F.col("centroid")).alias("dist"))


def densities(dists: DataFrame) -> DataFrame:
    return dists.groupBy("cluster_id").agg((1 / (F.avg("dist") + EPS)).alias("density"))


def representatives(dists: DataFrame) -> DataFrame:
    """The row closest to its centroid; the smallest id among equals."""
    best = F.min(F.struct("dist", "vec_id"))
    return dists.groupBy("cluster_id").agg(best.alias("best")).select("cluster_id", F.col("best.vec_id").alias("representative_idx"), F.col("best.dist").alias("representative_dist"))


def outlier_threshold(dists: DataFrame, percentile: float = 95.0) -> DataFrame:
    return exact_percentile(dists, "dist", percentile / 100, "threshold")


def outliers(dists: DataFrame, percentile: float = 95.0) -> DataFrame:
    return dists.crossJoin(F.broadcast(outlier_threshold(dists, percentile))).where("dist > threshold").select("vec_id", "cluster_id", "dist")


def edge_cases(dists: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Members of micro clusters and rows beyond the distance percentile, each once: (vec_id, cluster_id, reason)."""
    micro = sizes(dists).where(F.col("size") < cfg.micro_cluster_threshold).select("cluster_id", F.lit(True).alias("micro"))
    flagged = dists.join(micro, "cluster_id", "left").crossJoin(F.broadcast(outlier_threshold(dists, cfg.outlier_distance_percentile)))
    return flagged.where("micro or dist > threshold").select("vec_id", "cluster_id", F.when(F.col("micro"), "micro_cluster").otherwise("outlier").alias("reason"))


def voids(dists: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Clusters that aren't micro ones and whose density is under the percentile over all clusters."""
    low = (F.col("density") < F.col("limit")) & (F.col("size") >= cfg.micro_cluster_threshold)
    return _statistics(dists, cfg).where(low).select("cluster_id", "size", "density")


def _statistics(dists: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """(cluster_id, size, density, best, limit) from one aggregation of the distances; a row for each cluster."""
    stats = dists.groupBy("cluster_id").agg(F.count("*").alias("size"), (1 / (F.avg("dist") + EPS)).alias("density"), F.min(F.struct("dist", "vec_id")).alias("best"))
    return stats.crossJoin(F.broadcast(stats.agg(F.percentile("density", cfg.low_density_percentile / 100).alias("limit"))))


def cluster_info(df: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), paths: DataFrame | None = None) -> DataFrame:
    """A row for each cluster with all of the above. `paths` (vec_id, path): the representative's path, null without one."""
    centres = centroids(df)
    micro = F.col("size") < cfg.micro_cluster_threshold
    info = _statistics(distances(df, centres), cfg).join(centres, "cluster_id").withColumn("representative_idx", F.col("best.vec_id"))
    if paths is None:
        info = info.withColumn("representative_path", F.lit(None).cast("string"))
    else:
        info = info.join(paths.select(F.col("vec_id").alias("representative_idx"), F.col("path").alias("representative_path")), "representative_idx", "left")
    low = ~micro & (F.col("density") < F.col("limit"))
    return info.select("cluster_id", "size", "centroid", "density", "representative_idx", "representative_path", micro.alias("is_micro_cluster"), low.alias("is_low_density"))


def summary(df: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """One row: rows, clusters, edge cases, voids."""
    dists = distances(df)
    return (
        df.agg(F.count("*").alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters"))
        .crossJoin(edge_cases(dists, cfg).agg(F.count("*").alias("n_edge_cases")))
        .crossJoin(voids(dists, cfg).agg(F.count("*").alias("n_voids")))
    )


def require_rows(df: DataFrame) -> DataFrame:
    if df.limit(1).isEmpty():
        raise AnalysisError("there is nothing to analyse")
    return df
