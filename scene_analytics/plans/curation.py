"""From clips or embeddings to clusters, edge cases, voids and captions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import captions, clusters, community, descent, knn, leiden, spectral
from ..operators.lineage import stored
from ..sources import embeddings as sources


@dataclass(frozen=True)
class ClusteringConfig:
    k_neighbors: int = 15
    neighbours: str = "exact"  # or "descent": approximate, for the cosine, with work that isn't quadratic
    metric: str = "cosine"
    resolution: float = 1.0
    n_iterations: int = -1  # runs of Leiden; -1: until one brings no rise
    random_state: int = 42
    method: str = "leiden"  # or "spectral", "power_iteration", "label_propagation"


@dataclass(frozen=True)
class CurationConfig:
    clustering: ClusteringConfig = field(default_factory=ClusteringConfig)
    analysis: clusters.AnalysisConfig = field(default_factory=clusters.AnalysisConfig)


@dataclass
class CurationResult:
    labels: DataFrame
    clusters: DataFrame
    edge_cases: DataFrame
    voids: DataFrame
    captions: DataFrame | None
    failed: DataFrame | None = None


def build_graph(df: DataFrame, cfg: ClusteringConfig = ClusteringConfig()) -> DataFrame:
    if cfg.neighbours == "descent" and cfg.metric == "cosine":
        found = descent.top_k_descent(df, cfg.k_neighbors, seed=cfg.random_state)
    elif cfg.neighbours == "exact":
        found = knn.top_k(df, cfg.k_neighbors, cfg.metric)
    else:
        raise ValueError(f"no {cfg.neighbours} neighbours for {cfg.metric}")
    return knn.symmetric_edges(knn.similarities(found, cfg.metric))


def fit_predict(df: DataFrame, cfg: ClusteringConfig = ClusteringConfig()) -> DataFrame:
    """(vec_id, cluster_id)."""
    edges = build_graph(df, cfg)
    nodes = df.select("vec_id")
    if cfg.method == "leiden":
        return leiden.leiden(edges, nodes, cfg.resolution, cfg.random_state, cfg.n_iterations)
    if cfg.method == "spectral":
        return spectral.spectral(edges, nodes=nodes, seed=cfg.random_state)
    return {"power_iteration": community.power_iteration, "label_propagation": community.label_propagation}[cfg.method](edges, nodes=nodes)


def run_from_embeddings(df: DataFrame, cfg: CurationConfig = CurationConfig(), captioner: Callable | None = None, with_captions: bool = True, fabricate_paths: bool = True) -> CurationResult:
    """`df` has vec_id, embedding and maybe path. Raises where it is empty."""
    clusters.require_rows(df)
    labels = fit_predict(df, cfg.clustering)
    labelled = stored(df.join(labels, "vec_id"))
    dists = clusters.distances(labelled)
    info = stored(clusters.cluster_info(labelled, cfg.analysis, labelled.select("vec_id", "path") if "path" in df.columns else None))
    made = None
    if with_captions:
        named = info.drop("representative_path").join(captions.representative_paths(info, fabricate_paths).withColumnRenamed("path", "representative_path"), "cluster_id")
        made = captions.caption_clusters(named, captioner).select("cluster_id", "representative_path", "caption")
    return CurationResult(labels, info, clusters.edge_cases(dists, cfg.analysis), clusters.voids(dists, cfg.analysis), made)


def run(clips: DataFrame, load_encoder: Callable, columns: list[str], cfg: CurationConfig = CurationConfig(), captioner: Callable | None = None, with_captions: bool = True) -> CurationResult:
    """`clips` has vec_id, path and what the encoder takes; clips that fail are left out and reported."""
    encoded = sources.encode(clips, load_encoder, columns).persist(StorageLevel.MEMORY_AND_DISK)
    result = run_from_embeddings(encoded.where("error is null").select("vec_id", "path", "embedding"), cfg, captioner, with_captions, fabricate_paths=False)
    result.failed = encoded.where("error is not null").select("vec_id", "path", "error")
    return result


def summarize(result: CurationResult) -> DataFrame:
    return captions.report(result.clusters, result.edge_cases)


def tally(encoded: DataFrame) -> tuple[int, int]:
    """How many rows are without and with an error."""
    r = encoded.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
    return r[0], r[1]


def worth_clustering(df: DataFrame, more_than: int = 10) -> bool:
    return df.limit(more_than + 1).count() > more_than


def quality(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(ari, nmi) of labels (vec_id, cluster_id) against truth (vec_id, label)."""
    from ..operators import quality as q

    table = q.contingency(labels.join(truth, "vec_id"), "label", "cluster_id")
    return q.adjusted_rand_index(table).crossJoin(q.normalized_mutual_information(table)).select(F.col("ari"), F.col("nmi"))
