"""The library's queries on the driver's tables or on generated frames, each beside the SQL that checks it."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color, names, vectors
from .operators import cameras as cams
from .operators import captions, clusters, community, components, descent, edits, filters, halo, knn, leiden, lineage, masks, quality, regions, sampling, spectral, temporal, tiles, vignetting
from .plans import curation, mask_jobs
from .sources import config, files, frames, png, tensors, video
from .sources import embeddings as encoders
from .streaming import tile_state
from .streaming import variance as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- embeddings -------------------------------------------------------------------------------------------------------------------

#: Two micro clusters beside the table's labels.
CLUSTER = "CASE WHEN vec_id < 2 THEN 100 WHEN vec_id = 2 THEN 101 ELSE label END"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.expr(CLUSTER).alias("cluster_id"), "label")


def dists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.distances(embeddings(spark, sf_dir))


E_SQL = f"e AS (SELECT vec_id, embedding::DOUBLE[] AS v, {CLUSTER} AS cluster_id, label FROM embeddings)"
C_SQL = f"""{E_SQL},
x AS (SELECT cluster_id, unnest(v) AS a, generate_subscripts(v, 1) AS pos FROM e),
m AS (SELECT cluster_id, pos, avg(a) AS a FROM x GROUP BY ALL),
n AS (SELECT cluster_id, sqrt(sum(a * a)) + 1e-8 AS n FROM m GROUP BY ALL),
c AS (SELECT cluster_id, list(a / n ORDER BY pos) AS centroid FROM m JOIN n USING (cluster_id) GROUP BY ALL),
d AS (SELECT vec_id, cluster_id, list_distance(v, centroid) AS dist FROM e JOIN c USING (cluster_id))"""
Q_SQL = f"""{C_SQL},
s AS (SELECT cluster_id, count(*) AS size, 1 / (avg(dist) + 1e-8) AS density FROM d GROUP BY ALL),
t AS (SELECT quantile_cont(dist, 0.95) AS thr FROM d),
lim AS (SELECT quantile_cont(density, 0.1) AS lim FROM s),
ec AS (SELECT vec_id, d.cluster_id, CASE WHEN size < 3 THEN 'micro_cluster' ELSE 'outlier' END AS reason FROM d JOIN s USING (cluster_id), t WHERE size < 3 OR dist > thr),
vo AS (SELECT cluster_id, size, density FROM s, lim WHERE density < lim AND size >= 3),
rep AS (SELECT cluster_id, arg_min(vec_id, (dist, vec_id)) AS representative_idx FROM d GROUP BY ALL)"""
DENSITY = "round(least(density, 1e6), 6) AS density"


def clamped(df: DataFrame) -> DataFrame:
    """A single row's density is rounding noise."""
    return df.withColumn("density", F.round(F.least("density", F.lit(1e6)), 6))


@query(f"WITH {E_SQL} SELECT cluster_id, count(*) AS size FROM e GROUP BY ALL")
def cluster_sizes(spark, sf_dir):
    return clusters.sizes(embeddings(spark, sf_dir))


@query(f"WITH {E_SQL} SELECT count(DISTINCT cluster_id) AS n_clusters FROM e")
def cluster_count(spark, sf_dir):
    return clusters.distinct_clusters(embeddings(spark, sf_dir))


@query(f"WITH {C_SQL} SELECT cluster_id, (pos - 1)::INTEGER AS pos, round(a / n, 6) AS value FROM m JOIN n USING (cluster_id)")
def cluster_centroids(spark, sf_dir):
    c = clusters.centroids(embeddings(spark, sf_dir)).select("cluster_id", F.posexplode("centroid").alias("pos", "value"))
    return rounded(c, "value")


@query(f"WITH {C_SQL} SELECT vec_id, cluster_id, round(dist, 6) AS dist FROM d")
def cluster_distances(spark, sf_dir):
    return rounded(dists(spark, sf_dir), "dist")


@query(f"WITH {Q_SQL} SELECT cluster_id, {DENSITY} FROM s")
def cluster_density(spark, sf_dir):
    return clamped(clusters.densities(dists(spark, sf_dir)))


@query(f"WITH {Q_SQL} SELECT cluster_id, representative_idx FROM rep")
def cluster_representatives(spark, sf_dir):
    return clusters.representatives(dists(spark, sf_dir)).select("cluster_id", "representative_idx")


@query(f"WITH {Q_SQL} SELECT vec_id, cluster_id, round(dist, 6) AS dist FROM d, t WHERE dist > thr")
def cluster_outliers(spark, sf_dir):
    return rounded(clusters.outliers(dists(spark, sf_dir)), "dist")


@query(f"WITH {Q_SQL} SELECT * FROM ec")
def cluster_edge_cases(spark, sf_dir):
    return clusters.edge_cases(dists(spark, sf_dir))


@query(f"WITH {Q_SQL} SELECT cluster_id, size, {DENSITY} FROM vo")
def cluster_voids(spark, sf_dir):
    return clamped(clusters.voids(dists(spark, sf_dir)))


@query(f"""WITH {Q_SQL} SELECT cluster_id, s.size, {DENSITY.replace('density,', 's.density,')}, representative_idx, s.size < 3 AS is_micro_cluster, vo.cluster_id IS NOT NULL AS is_low_density
FROM s JOIN rep USING (cluster_id) LEFT JOIN vo USING (cluster_id)""")
def cluster_info(spark, sf_dir):
    return clamped(clusters.cluster_info(embeddings(spark, sf_dir)).drop("centroid", "representative_path"))


@query(f"WITH {Q_SQL} SELECT (SELECT count(*) FROM e) AS n_rows, (SELECT count(DISTINCT cluster_id) FROM e) AS n_clusters, (SELECT count(*) FROM ec) AS n_edge_cases, (SELECT count(*) FROM vo) AS n_voids")
def analysis_summary(spark, sf_dir):
    return clusters.summary(embeddings(spark, sf_dir))


@query(f"WITH {E_SQL} SELECT vec_id, list_transform(v, lambda a: round(a / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6)) AS unit FROM e")
def l2_normalize(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.transform(vectors.l2_normalize(F.col("embedding")), lambda a: vectors.rounded(a)).alias("unit"))


K_SQL = f"""{E_SQL},
p AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS distance, list_distance(a.v, b.v) AS euclid FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst)::INTEGER AS rank FROM p QUALIFY rank <= 15),
u AS (SELECT src, dst, euclid, row_number() OVER (PARTITION BY src ORDER BY euclid, dst) AS rank FROM p QUALIFY rank <= 15),
b AS (SELECT src, dst, 1 - distance AS s FROM k UNION ALL SELECT dst, src, 1 - distance FROM k),
w AS (SELECT src, dst, least(sum(s), 1.0) AS weight FROM b GROUP BY ALL HAVING weight <> 0)"""


@query(f"WITH {K_SQL} SELECT src, dst, round(distance, 6) AS distance, rank FROM k")
def knn_topk(spark, sf_dir):
    return rounded(knn.top_k(embeddings(spark, sf_dir)), "distance")


@query(f"WITH {K_SQL} SELECT src, dst, round(1 - distance, 6) AS similarity FROM k")
def knn_similarity(spark, sf_dir):
    return rounded(knn.similarities(knn.top_k(embeddings(spark, sf_dir))), "similarity")


@query(f"WITH {K_SQL}, sg AS (SELECT median(euclid) AS sigma FROM u) SELECT src, dst, round(exp(-euclid * euclid / (2 * sigma * sigma)), 6) AS similarity FROM u, sg")
def knn_gaussian_kernel(spark, sf_dir):
    return rounded(knn.similarities(knn.top_k(embeddings(spark, sf_dir), metric="euclidean"), "euclidean"), "similarity")


@query(f"WITH {K_SQL} SELECT src, dst, round(weight, 6) AS weight FROM w")
def knn_edges_symmetric(spark, sf_dir):
    return rounded(curation.build_graph(embeddings(spark, sf_dir)), "weight")


@query(f"WITH {K_SQL} SELECT src, count(*) AS degree, round(sum(weight), 6) AS strength FROM w GROUP BY ALL")
def knn_degree(spark, sf_dir):
    return rounded(knn.degrees(curation.build_graph(embeddings(spark, sf_dir))), "strength")


@query()
def knn_lsh(spark, sf_dir):
    return rounded(knn.top_k_lsh(embeddings(spark, sf_dir)), "distance")


@query("SELECT vec_id AS src, least(15, (SELECT count(*) FROM embeddings) - 1) AS n, true AS apart FROM embeddings")
def knn_descent(spark, sf_dir):
    """How many neighbours each row gets, and whether they are different ones, nearest first."""
    found = descent.top_k_descent(embeddings(spark, sf_dir), leaf=64)
    at = F.transform(F.array_sort(F.collect_list(F.struct("rank", "distance", "dst"))), lambda x: x["distance"])
    apart = (F.count_distinct("dst") == F.count("*")) & F.every(F.col("src") != F.col("dst")) & (F.array_sort(at) == at)
    return found.groupBy("src").agg(F.count("*").alias("n"), apart.alias("apart"))


@query("SELECT count(*) AS rows, sum(least(15, (SELECT count(*) FROM embeddings) - 1))::BIGINT AS expected, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def knn_descent_recall(spark, sf_dir):
    """Every 50th row's neighbours against the exact ones; nine of ten are enough."""
    df = embeddings(spark, sf_dir)
    exact = knn.top_k(df, sources=df.where("vec_id % 50 = 0"))
    return descent.recall(descent.top_k_descent(df, leaf=64), exact).select("rows", "expected", (F.col("found") >= 0.9 * F.col("expected")).alias("enough"))


ONE_RUN = curation.ClusteringConfig(n_iterations=1)


@query()
def leiden_labels(spark, sf_dir):
    return curation.fit_predict(embeddings(spark, sf_dir).select("vec_id", "embedding"), ONE_RUN)


@query("SELECT count(*) AS rows, true AS connected, true AS better FROM embeddings")
def leiden_quality(spark, sf_dir):
    """Whether the clusters are connected, and their modularity beats that of label propagation."""
    df = embeddings(spark, sf_dir)
    edges = lineage.stored(curation.build_graph(df))
    found = lineage.stored(leiden.leiden(edges, df.select("vec_id"), n_iterations=1).withColumnRenamed("cluster_id", "label"))
    side = lambda c: found.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_of"))
    inner = edges.join(side("src"), "src").join(side("dst"), "dst").where("src_of = dst_of").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    parts = components.connected_components(inner.unionByName(found.select(F.col("vec_id").alias("u"), F.col("vec_id").alias("v"))))
    spread = community.label_propagation(edges, 4).withColumnRenamed("cluster_id", "label")
    reached, other = (leiden.modularity(edges, labels).first()[0] for labels in (found, spread))
    connected = F.count_distinct("root") == F.count_distinct("label")
    return parts.join(found, F.col("node") == F.col("vec_id")).agg(F.count("*").alias("rows"), connected.alias("connected")).withColumn("better", F.lit(reached > other))


CLIQUE = 20


@query(f"WITH g AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY vec_id // {CLIQUE}) AS first, count(*) OVER (PARTITION BY vec_id // {CLIQUE}) AS n FROM embeddings) SELECT vec_id, (dense_rank() OVER (ORDER BY n DESC, first) - 1)::INT AS cluster_id FROM g")
def leiden_cliques(spark, sf_dir):
    """The twenties of `_cliques` are the clusters."""
    df, edges = _cliques(spark, sf_dir)
    return leiden.leiden(edges, df, resolution=4.0, n_iterations=1)


def _cliques(spark, sf_dir):
    """Twenty rows in a row all know each other, and weakly the next twenty."""
    df = embeddings(spark, sf_dir).select("vec_id")
    near = df.select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(CLIQUE))).alias("by")).select(F.col("vec_id").alias("src"), (F.col("vec_id") + F.col("by")).alias("dst"))
    near = near.join(df.withColumnRenamed("vec_id", "dst"), "dst").withColumn("weight", F.when(F.expr(f"src DIV {CLIQUE} = dst DIV {CLIQUE}"), 1.0).otherwise(0.02))
    return df, near.select("src", "dst", "weight").unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


GROUPS = 16


@query(f"WITH g AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY vec_id % {GROUPS}) AS first, count(*) OVER (PARTITION BY vec_id % {GROUPS}) AS n FROM embeddings) SELECT vec_id, (dense_rank() OVER (ORDER BY n DESC, first) - 1)::INT AS cluster_id FROM g")
def spectral_groups(spark, sf_dir):
    """Sixteen groups whose rows know six others of their group drawn by hash, and weakly the next row: these groups are the clusters."""
    df = embeddings(spark, sf_dir).select("vec_id")
    n = df.count()
    drawn = (F.pmod(F.xxhash64("vec_id", "j"), F.lit(max(n, 1))) / GROUPS).cast("long") * GROUPS + F.col("vec_id") % GROUPS
    near = df.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j")).select(F.col("vec_id").alias("src"), F.when(F.col("j") > 0, drawn).otherwise(F.col("vec_id") + 1).alias("dst"), F.when(F.col("j") > 0, 1.0).otherwise(0.01).alias("weight"))
    near = near.where(f"src <> dst and dst < {n}")
    edges = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return spectral.spectral(edges, GROUPS, df)


@query("SELECT unnest(range(1, 9))::INT AS component, true AS falling, true AS settled FROM (SELECT count(*) AS n FROM embeddings) WHERE n >= 8")
def spectral_residuals(spark, sf_dir):
    """Whether the eight largest eigenvalues of the neighbours' graph fall, from one, and A x is as near to e x as it has to be."""
    _, values, residual = spectral.eigenvectors(curation.build_graph(embeddings(spark, sf_dir)), 8)
    falls = [bool(abs(values[0] - 1) < 1e-9), *(bool(a >= b) for a, b in zip(values, values[1:], strict=False))]
    return spark.createDataFrame([(i, f, bool(r <= spectral.TOLERANCE)) for i, (f, r) in enumerate(zip(falls, residual, strict=True), 1)], "component int, falling boolean, settled boolean")


@query()
def pic_labels(spark, sf_dir):
    return community.power_iteration(curation.build_graph(embeddings(spark, sf_dir)))


def _votes(rounds: int) -> str:
    sql = ", l0 AS (SELECT DISTINCT src AS vec_id, src AS label FROM w)"
    for i in range(rounds):
        sql += f", v{i} AS (SELECT src, label, sum(weight) AS n FROM w JOIN l{i} ON vec_id = dst GROUP BY ALL), l{i + 1} AS (SELECT src AS vec_id, arg_max(label, (n, -label)) AS label FROM v{i} GROUP BY ALL)"
    return sql


@query(f"""WITH {K_SQL.replace("w AS (", "w AS MATERIALIZED (")}{_votes(4)}, z AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) - 1 AS place FROM l4 GROUP BY label)
SELECT vec_id, place::INT AS cluster_id FROM l4 JOIN z USING (label)""")
def propagation_labels(spark, sf_dir):
    return community.label_propagation(curation.build_graph(embeddings(spark, sf_dir)), 4)


@query()
def curation_run(spark, sf_dir):
    r = curation.run_from_embeddings(embeddings(spark, sf_dir).select("vec_id", "embedding"), curation.CurationConfig(clustering=ONE_RUN))
    return r.clusters.join(r.captions.drop("representative_path"), "cluster_id", "left").select("cluster_id", "size", "representative_idx", "is_micro_cluster", "is_low_density", "caption")


# --- captions, paths, agreement -----------------------------------------------------------------------------------------------------

_TYPES = ", ".join(f"'{t}'" for t in captions.SCENE_TYPES)
CAPTION_SQL = f"'Cluster ' || cluster_id || ': ' || ([{_TYPES}])[cluster_id % {len(captions.SCENE_TYPES)} + 1]"


@query(f"WITH {E_SQL} SELECT DISTINCT cluster_id, {CAPTION_SQL} AS caption FROM e")
def cluster_captions(spark, sf_dir):
    return captions.caption_clusters(embeddings(spark, sf_dir).select("cluster_id").distinct())


PATH = "CASE WHEN vec_id % 3 = 0 THEN '' WHEN vec_id % 3 = 1 THEN 'clip_' || vec_id || '.mp4' END"


@query(f"WITH {Q_SQL} SELECT cluster_id, coalesce(nullif({PATH}, ''), 'video_' || representative_idx || '.mp4') AS path FROM rep JOIN e ON e.vec_id = representative_idx".replace("SELECT cluster_id, coalesce", "SELECT rep.cluster_id, coalesce"))
def representative_paths(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return captions.representative_paths(clusters.cluster_info(df, paths=df.select("vec_id", F.expr(PATH).alias("path"))))


@query(f"WITH {E_SQL} SELECT vec_id FROM e WHERE NOT (vec_id % 7 = 0)")
def failed_clip_antijoin(spark, sf_dir):
    df = embeddings(spark, sf_dir).select("vec_id")
    return captions.drop_failed(df, df.where("vec_id % 7 = 0"), "vec_id")


FOLDER = """CASE vec_id % 5 WHEN 0 THEN '/data/24.01w/N1234567-' || lpad(CAST(vec_id AS VARCHAR(20)), 12, '0') || '/RAW_DB/a_CMR_1/CMR_GT_Frame'
WHEN 1 THEN '/d/N1111111-000000000000/x/N2222222-' || lpad(CAST(vec_id AS VARCHAR(20)), 12, '0') WHEN 2 THEN '/d/clip' || vec_id
WHEN 3 THEN '/N1234567-000000000000/1/2/3/4/5/6/7/8/9/end' || vec_id ELSE '/N1234567-000000000000/1/2/3/4/5/6/7/8/9/10/end' || vec_id END"""


@query(f"""WITH p AS (SELECT vec_id, string_split({FOLDER}, '/') AS parts FROM embeddings),
f AS (SELECT vec_id, parts, list_filter(parts[-10:], lambda s: regexp_full_match(s, 'N[0-9]{{7}}-[0-9]{{12}}')) AS hits FROM p)
SELECT vec_id, coalesce(hits[-1], parts[-1]) || '.mp4' AS video FROM f""")
def name_extraction(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", names.session_name(F.expr(FOLDER)).alias("video"))


G_SQL = "g AS (SELECT label AS truth, vec_id % 4 AS pred, count(*) AS n FROM embeddings GROUP BY ALL), a AS (SELECT truth, sum(n) AS n FROM g GROUP BY ALL), b AS (SELECT pred, sum(n) AS n FROM g GROUP BY ALL), z AS (SELECT sum(n)::DOUBLE AS t FROM g)"


def _contingency(spark, sf_dir):
    return quality.contingency(embeddings(spark, sf_dir).withColumn("pred", F.expr("vec_id % 4")), "label", "pred")


@query(f"""WITH {G_SQL}, q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM g) AS x, (SELECT sum(n * (n - 1) / 2) FROM a) AS p, (SELECT sum(n * (n - 1) / 2) FROM b) AS r, t FROM z)
SELECT round((x - p * r / (t * (t - 1) / 2)) / ((p + r) / 2 - p * r / (t * (t - 1) / 2)), 6) AS ari FROM q""")
def rand_index(spark, sf_dir):
    return rounded(quality.adjusted_rand_index(_contingency(spark, sf_dir)), "ari")


@query(f"""WITH {G_SQL} SELECT round(2 * (SELECT sum(g.n / t * ln(g.n * t / (a.n * b.n))) FROM g JOIN a USING (truth) JOIN b USING (pred), z)
/ ((SELECT -sum(n / t * ln(n / t)) FROM a, z) + (SELECT -sum(n / t * ln(n / t)) FROM b, z)), 6) AS nmi""")
def nmi(spark, sf_dir):
    return rounded(quality.normalized_mutual_information(_contingency(spark, sf_dir)), "nmi")


# --- frames made of a table: twenty vectors are a frame, five frames a camera -----------------------------------------------------------

H, W_, PER_FRAME, PER_CAMERA = 40, 32, 20, 5
#: The rows that the last frame lacks are the first ones of the table again.
_SLOTS = f"explode(CASE WHEN vec_id + n < {PER_FRAME} * ceil(n / {PER_FRAME}e0) THEN array(vec_id, vec_id + n) ELSE array(vec_id) END)"


def _place_columns(div: str, i: str) -> list[str]:
    return [
        f"concat('cam', CAST(slot {div} {PER_FRAME * PER_CAMERA} AS VARCHAR(20))) AS camera_id",
        f"CAST((slot {div} {PER_FRAME * PER_CAMERA}) % 2 AS INT) AS dim",
        f"CAST((slot {div} {PER_FRAME}) % {PER_CAMERA} AS INT) AS frame_idx",
        f"CAST((slot % {PER_FRAME}) * 2 + {i} {div} {W_} AS INT) AS y",
        f"CAST({i} % {W_} AS INT) AS x",
        "CAST(floor(v * 1000e0) AS BIGINT) AS n",
    ]


_RADIUS2 = f"((x - {W_ / 2}e0) * (x - {W_ / 2}e0) + (y - {H / 2}e0) * (y - {H / 2}e0)) / {(W_ / 2) ** 2 + (H / 2) ** 2}e0"


def _level(ch: int) -> str:
    """Nearly still in the lower quarter, moving elsewhere; every other camera darkens towards its corners."""
    level = f"CASE WHEN y >= 30 THEN least(255, (x * 7 + y * 13 + {40 * ch}) % 256 + (n % 2 + 2) % 2) ELSE ((x * 7 + y * 13 + n + {40 * ch}) % 256 + 256) % 256 END"
    return f"CAST(floor(({level}) * CASE WHEN dim = 1 THEN greatest(0e0, 1e0 - 0.6e0 * {_RADIUS2}) ELSE 1e0 END) AS INT)"


_LEVELS = ", ".join(f"{_level(i)} AS {c}" for i, c in enumerate("bgr"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir).select("vec_id", "embedding")
    slots = df.crossJoin(F.broadcast(df.agg(F.count("*").alias("n")))).select(F.expr(_SLOTS).alias("slot"), vectors.doubles(F.col("embedding")).alias("v"))
    places = slots.select("slot", F.posexplode("v").alias("i", "v")).selectExpr(*_place_columns("DIV", "i"))
    return places.selectExpr("camera_id", "frame_idx", "y", "x", *[f"{_level(i)} AS {c}" for i, c in enumerate("bgr")])


def _linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255e0 <= 0.04045e0 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END)"


_Y = f"(0.212671e0 * {_linear('r')} + 0.715160e0 * {_linear('g')} + 0.072169e0 * {_linear('b')})"
_SLOTS_SQL = _SLOTS.replace("explode(", "unnest(").replace("array(vec_id, vec_id + n)", "[vec_id, vec_id + n]").replace("array(vec_id)", "[vec_id]").replace("ceil(", "CAST(ceil(").replace("e0) THEN", "e0) AS BIGINT) THEN")
P_SQL = f"""sl AS (SELECT {_SLOTS_SQL} AS slot, embedding::DOUBLE[] AS v FROM embeddings, (SELECT count(*) AS n FROM embeddings)),
px AS MATERIALIZED (SELECT camera_id, frame_idx, y, x, {_LEVELS} FROM (SELECT {', '.join(_place_columns('//', 'i'))} FROM (SELECT slot, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM sl))),
li AS (SELECT *, CAST(floor(0.299e0 * r + 0.587e0 * g + 0.114e0 * b + 0.5e0) AS INT) AS gray,
  CAST(floor((CASE WHEN yy > 0.008856e0 THEN 116 * cbrt(yy) - 16 ELSE 903.3e0 * yy END) * 255 / 100 + 0.5e0) AS INT) AS light FROM (SELECT *, {_Y} AS yy FROM px)),
va AS MATERIALIZED (SELECT camera_id, y, x, (count(*) * sum(light * light) - sum(light) * sum(light))::DOUBLE / (count(*) * count(*)) AS variance, avg(light) / 255 AS brightness FROM li GROUP BY ALL),
sm AS (SELECT camera_id, y, x, CASE WHEN variance < 50 THEN 255 ELSE 0 END AS mask FROM va)"""


def _var(spark, sf_dir):
    return temporal.variance(pixels(spark, sf_dir))


@query(f"WITH {P_SQL} SELECT camera_id, frame_idx, y, x, gray FROM li")
def gray(spark, sf_dir):
    return pixels(spark, sf_dir).select("camera_id", "frame_idx", "y", "x", color.gray(F.col("b"), F.col("g"), F.col("r")).alias("gray"))


@query(f"WITH {P_SQL} SELECT camera_id, frame_idx, y, x, light FROM li")
def lightness(spark, sf_dir):
    return pixels(spark, sf_dir).select("camera_id", "frame_idx", "y", "x", color.lightness(F.col("b"), F.col("g"), F.col("r")).alias("light"))


@query(f"WITH {P_SQL} SELECT camera_id, y, x, round(variance, 6) AS variance FROM va")
def temporal_variance_lab(spark, sf_dir):
    return rounded(_var(spark, sf_dir), "variance")


@query(f"WITH {P_SQL} SELECT camera_id, y, x, round((count(*) * sum(gray * gray) - sum(gray) * sum(gray))::DOUBLE / (count(*) * count(*)), 6) AS variance FROM li GROUP BY ALL")
def temporal_variance_gray(spark, sf_dir):
    return rounded(temporal.variance(pixels(spark, sf_dir), "gray"), "variance")


@query(f"WITH {P_SQL} SELECT camera_id, y, x, round((var_pop(b) + var_pop(g) + var_pop(r)) / 3, 6) AS variance FROM px GROUP BY ALL")
def temporal_variance_bgr(spark, sf_dir):
    return rounded(temporal.variance(pixels(spark, sf_dir), "bgr"), "variance")


@query(f"WITH {P_SQL} SELECT camera_id, y, x, floor(avg(b))::INT AS b, floor(avg(g))::INT AS g, floor(avg(r))::INT AS r FROM px GROUP BY ALL")
def temporal_mean(spark, sf_dir):
    return temporal.mean_frame(pixels(spark, sf_dir))


@query(f"WITH {P_SQL} SELECT * FROM sm")
def static_mask(spark, sf_dir):
    return temporal.static_mask(_var(spark, sf_dir))


@query(f"WITH {P_SQL} SELECT camera_id, y, x, round(1 / (1 + exp((variance - 50) / (50e0 / 3))), 6) AS confidence FROM va")
def confidence(spark, sf_dir):
    return rounded(temporal.confidence(_var(spark, sf_dir)), "confidence")


@query(f"WITH {P_SQL} SELECT camera_id, (y // 8)::INT AS by, (x // 8)::INT AS bx, round(least(50e0, 2 * quantile_cont(variance, 0.1)), 6) AS threshold FROM va GROUP BY ALL")
def adaptive_threshold(spark, sf_dir):
    return rounded(temporal.block_thresholds(_var(spark, sf_dir), temporal.TemporalConfig(block_size=8)), "threshold")


@query(f"WITH {P_SQL} SELECT camera_id, y, x, round(brightness, 6) AS brightness FROM va")
def brightness_map(spark, sf_dir):
    return rounded(vignetting.brightness_map(pixels(spark, sf_dir)), "brightness")


R_SQL = f"""{P_SQL},
di AS (SELECT *, sqrt((x - {W_ / 2}) * (x - {W_ / 2}) + (y - {H / 2}) * (y - {H / 2})) / sqrt({(W_ / 2) ** 2 + (H / 2) ** 2}) AS d FROM va),
ri AS (SELECT camera_id, floor(d * 100)::INT AS bin, avg(brightness) AS m FROM di WHERE floor(d * 100) < 100 GROUP BY ALL),
pr AS (SELECT c.camera_id, range::INT AS bin, (range + 0.5e0) / 100 AS radius, coalesce(m, 0e0) AS brightness FROM (SELECT DISTINCT camera_id FROM va) c, range(100) LEFT JOIN ri ON ri.camera_id = c.camera_id AND ri.bin = range),
ce AS (SELECT camera_id, max(brightness) FILTER (WHERE bin < 10) AS centre FROM pr GROUP BY ALL),
ra AS (SELECT camera_id, coalesce(max(radius) FILTER (WHERE brightness >= centre * 0.7e0), 0.5e0) AS radius FROM pr JOIN ce USING (camera_id) GROUP BY ALL),
mi AS (SELECT camera_id, avg(brightness) AS centre FROM va WHERE y >= {H // 3} AND y < {2 * H // 3} AND x >= {W_ // 3} AND x < {2 * W_ // 3} GROUP BY ALL)"""


def _bright(spark, sf_dir):
    return vignetting.brightness_map(pixels(spark, sf_dir))


@query(f"WITH {R_SQL} SELECT camera_id, bin, round(radius, 6) AS radius, round(brightness, 6) AS brightness FROM pr")
def radial_profile(spark, sf_dir):
    return rounded(vignetting.radial_profile(_bright(spark, sf_dir)), "radius", "brightness")


@query(f"WITH {R_SQL} SELECT camera_id, round(radius, 6) AS radius FROM ra")
def radial_radius(spark, sf_dir):
    return rounded(vignetting.radial_radius(_bright(spark, sf_dir)), "radius")


@query(f"WITH {R_SQL} SELECT camera_id, y, x, CASE WHEN d > radius THEN 255 ELSE 0 END AS mask FROM di JOIN ra USING (camera_id)")
def radial_mask(spark, sf_dir):
    return vignetting.radial_mask(_bright(spark, sf_dir))


@query(f"WITH {R_SQL} SELECT camera_id, y, x, CASE WHEN brightness < centre * 0.7e0 OR brightness < 0.3e0 THEN 255 ELSE 0 END AS mask FROM va JOIN mi USING (camera_id)")
def threshold_mask(spark, sf_dir):
    return vignetting.threshold_mask(_bright(spark, sf_dir))


@query(f"WITH {R_SQL} SELECT camera_id, y, x, CASE WHEN (y < 9 OR y >= {H - 9} OR x < 9 OR x >= {W_ - 9}) AND brightness < centre * 0.6e0 THEN 255 ELSE 0 END AS mask FROM va JOIN mi USING (camera_id)")
def edge_mask(spark, sf_dir):
    return vignetting.edge_mask(_bright(spark, sf_dir), margin=9, close=0)


def _morph_sql(source: str, steps: str, k: int, shape: str = "ellipse", name: str = "st") -> tuple[str, str]:
    """CTEs that dilate (d) and erode (e) step by step by giving each level to all places whose kernel covers it; the last one's name.

    The places are said here in SQL: those of a square, or in each row as far as an ellipse of k by k reaches, rounded half to even.
    """
    r = k // 2
    inside = f"abs(dx) <= round_even(sqrt({r * r} - dy * dy), 0)" if shape == "ellipse" else "true"
    sql, last = f"{name}_k AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range({-r}, {r + 1})) AS i) a, (SELECT unnest(range({-r}, {r + 1})) AS i) b WHERE {inside.replace('dx', 'b.i').replace('dy', 'a.i')})", source
    for i, s in enumerate(steps):
        sql += f", {name}{i} AS MATERIALIZED (SELECT camera_id, ty AS y, tx AS x, {'max' if s == 'd' else 'min'}(mask) AS mask FROM (SELECT camera_id, y - dy AS ty, x - dx AS tx, mask FROM {last}, {name}_k) WHERE ty BETWEEN 0 AND {H - 1} AND tx BETWEEN 0 AND {W_ - 1} GROUP BY ALL)"
        last = f"{name}{i}"
    return sql, last


def _mask_query(steps: str, k: int = 5) -> str:
    sql, last = _morph_sql("sm", steps, k)
    return f"WITH {P_SQL}, {sql} SELECT * FROM {last}"


def _static(spark, sf_dir):
    return temporal.static_mask(_var(spark, sf_dir))


@query(_mask_query("d"))
def dilate(spark, sf_dir):
    return filters.morphology_window(_static(spark, sf_dir), "dilate")


@query(_mask_query("e"))
def erode(spark, sf_dir):
    return filters.morphology_window(_static(spark, sf_dir), "erode")


@query(_mask_query("ddee"))
def mask_close(spark, sf_dir):
    return filters.morphology(_static(spark, sf_dir), "close")


@query(_mask_query("eedd"))
def mask_open(spark, sf_dir):
    return filters.morphology(_static(spark, sf_dir), "open")


_KERNEL = ", ".join(f"({i - 12}, {w!r}e0)" if "e" not in repr(float(w)) else f"({i - 12}, {float(w)!r})" for i, w in enumerate(float(v) for v in filters.gaussian_kernel(3.0)))
_REFLECT = "CASE WHEN {c} + o < 0 THEN -({c} + o) - 1 WHEN {c} + o >= {n} THEN 2 * {n} - 1 - ({c} + o) ELSE {c} + o END"


@query(f"""WITH {P_SQL}, gk(o, w) AS (VALUES {_KERNEL}),
g1 AS (SELECT p.camera_id, p.y, p.x, sum(q.mask / 255e0 * w) AS v FROM sm p, gk JOIN sm q ON q.camera_id = p.camera_id AND q.x = p.x AND q.y = {_REFLECT.format(c='p.y', n=H)} GROUP BY ALL),
g2 AS (SELECT p.camera_id, p.y, p.x, sum(q.v * w) AS v FROM g1 p, gk JOIN g1 q ON q.camera_id = p.camera_id AND q.y = p.y AND q.x = {_REFLECT.format(c='p.x', n=W_)} GROUP BY ALL)
SELECT camera_id, y, x, CASE WHEN v > 0.5 THEN 255 ELSE 0 END AS mask FROM g2""")
def gaussian_smooth(spark, sf_dir):
    return filters.smooth_boundary(_static(spark, sf_dir))


@query(f"WITH {R_SQL} SELECT camera_id, y, x, CASE WHEN d > radius OR variance < 50 THEN 255 ELSE 0 END AS mask FROM di JOIN ra USING (camera_id)")
def mask_union(spark, sf_dir):
    return masks.union(_static(spark, sf_dir), vignetting.radial_mask(_bright(spark, sf_dir)))


REGIONS = [(5, 15, 20, 10), (20, 32, 40, 40), (0, 0, 3, 3)]


@query(f"""WITH {P_SQL}, ro(rx, ry, rw, rh) AS (VALUES {", ".join(map(str, REGIONS))})
SELECT camera_id, y, x, CASE WHEN 1 / (1 + exp((variance - 400) / (400e0 / 3))) > 0.3 AND EXISTS (SELECT 1 FROM ro WHERE x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh) THEN 255 WHEN variance < 50 THEN 255 ELSE 0 END AS mask FROM va""")
def roi_hints(spark, sf_dir):
    v = _var(spark, sf_dir)
    box = F.explode(F.array(*[F.struct(*[F.lit(n).alias(c) for n, c in zip(r, ("x", "y", "width", "height"), strict=True)]) for r in REGIONS]))
    regions = v.select("camera_id").distinct().select("camera_id", box.alias("r")).select("camera_id", "r.*")
    return masks.apply_roi_hints(temporal.static_mask(v), temporal.confidence(v, 400.0), regions)


@query(f"WITH {P_SQL} SELECT px.camera_id, frame_idx, px.y, px.x, {', '.join(f'CASE WHEN mask > 127 THEN 7 ELSE {c} END AS {c}' for c in 'bgr')} FROM px JOIN sm USING (camera_id, y, x)")
def apply_mask(spark, sf_dir):
    return masks.apply_mask(pixels(spark, sf_dir), _static(spark, sf_dir), (7, 7, 7))


@query(f"WITH {P_SQL} SELECT px.camera_id, frame_idx, px.y, px.x, {', '.join(f'CASE WHEN mask > 127 THEN floor({v} * 0.5e0 + {c} * 0.5e0)::INT ELSE {c} END AS {c}' for c, v in zip('bgr', (0, 0, 255), strict=True))} FROM px JOIN sm USING (camera_id, y, x)")
def overlay_blend(spark, sf_dir):
    return masks.overlay(pixels(spark, sf_dir), _static(spark, sf_dir))


BLOB = "CASE WHEN (x * x * 7 + y * 13 * x + y * y + s) % 11 < 4 THEN 255 ELSE 0 END AS mask"
B_SQL = f"{P_SQL}, bl AS MATERIALIZED (SELECT camera_id, y, x, {BLOB} FROM (SELECT camera_id, y, x, sum(b) AS s FROM px GROUP BY ALL))"


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("camera_id", "y", "x").agg(F.sum("b").alias("s")).selectExpr("camera_id", "y", "x", BLOB)


@query(f"""WITH RECURSIVE {B_SQL}, r AS (SELECT camera_id, y, x FROM bl WHERE mask = 0 AND (y IN (0, {H - 1}) OR x IN (0, {W_ - 1}))
UNION SELECT b.camera_id, b.y, b.x FROM r JOIN bl b ON b.camera_id = r.camera_id AND b.mask = 0 AND abs(b.y - r.y) + abs(b.x - r.x) = 1)
SELECT bl.camera_id, bl.y, bl.x, CASE WHEN mask = 0 AND r.y IS NULL THEN 255 ELSE mask END AS mask FROM bl LEFT JOIN r USING (camera_id, y, x)""")
def fill_holes(spark, sf_dir):
    return masks.fill_holes(blobs(spark, sf_dir))


@query(f"""WITH RECURSIVE {B_SQL}, r AS (SELECT camera_id, y AS ry, x AS rx, y, x FROM bl WHERE mask = 255
UNION SELECT r.camera_id, ry, rx, b.y, b.x FROM r JOIN bl b ON b.camera_id = r.camera_id AND b.mask = 255 AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1),
s AS (SELECT camera_id, ry AS y, rx AS x, count(*) AS area FROM r GROUP BY ALL)
SELECT bl.camera_id, bl.y, bl.x, CASE WHEN area >= 8 THEN 255 ELSE 0 END AS mask FROM bl LEFT JOIN s USING (camera_id, y, x)""")
def remove_small_regions(spark, sf_dir):
    return masks.remove_small_regions(blobs(spark, sf_dir), 8)


def _smooth_sql(source: str, sigma: float, name: str) -> tuple[str, str]:
    """CTEs of the mask's Gaussian over one half; the last one's name."""
    kernel = filters.gaussian_kernel(sigma)
    r = len(kernel) // 2
    values = ", ".join(f"({i - r}, {float(w)!r}::DOUBLE)" for i, w in enumerate(kernel))
    return f"""{name}_g(o, w) AS (VALUES {values}),
{name}_y AS MATERIALIZED (SELECT t.camera_id, t.y, t.x, sum(q.mask / 255e0 * w) AS v FROM (SELECT p.*, w, {_REFLECT.format(c='p.y', n=H)} AS at FROM {source} p, {name}_g) t JOIN {source} q ON q.camera_id = t.camera_id AND q.x = t.x AND q.y = t.at GROUP BY ALL),
{name}_x AS MATERIALIZED (SELECT t.camera_id, t.y, t.x, CASE WHEN sum(q.v * w) > 0.5 THEN 255 ELSE 0 END AS mask FROM (SELECT p.*, w, {_REFLECT.format(c='p.x', n=W_)} AS at FROM {name}_y p, {name}_g) t JOIN {name}_y q ON q.camera_id = t.camera_id AND q.y = t.y AND q.x = t.at GROUP BY ALL)""", f"{name}_x"


def _refine_sql(source: str, least: int, name: str) -> tuple[str, str]:
    """CTEs that close, open, fill holes, drop regions of fewer than `least` pixels and smooth; the last one's name."""
    morph, last = _morph_sql(source, "ddeeeedd", 5, name=f"{name}_m")
    smooth, end = _smooth_sql(f"{name}_s", 3.0, f"{name}_b")
    return f"""{morph},
{name}_r AS (SELECT camera_id, y, x FROM {last} WHERE mask = 0 AND (y IN (0, {H - 1}) OR x IN (0, {W_ - 1}))
  UNION SELECT b.camera_id, b.y, b.x FROM {name}_r r JOIN {last} b ON b.camera_id = r.camera_id AND b.mask = 0 AND abs(b.y - r.y) + abs(b.x - r.x) = 1),
{name}_f AS MATERIALIZED (SELECT camera_id, y, x FROM {last} ANTI JOIN {name}_r USING (camera_id, y, x)),
{name}_l(camera_id, y, x, l) USING KEY (camera_id, y, x) AS (SELECT camera_id, y, x, y * {W_} + x FROM {name}_f
  UNION SELECT b.camera_id, b.y, b.x, min(a.l) FROM {name}_l a JOIN recurring.{name}_l b ON a.camera_id = b.camera_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.l < b.l GROUP BY ALL),
{name}_c AS MATERIALIZED (SELECT camera_id, y, x, count(*) OVER (PARTITION BY camera_id, l) AS area FROM {name}_l),
{name}_s AS MATERIALIZED (SELECT p.camera_id, p.y, p.x, CASE WHEN area >= {least} THEN 255 ELSE 0 END AS mask FROM {source} p LEFT JOIN {name}_c USING (camera_id, y, x)),
{smooth}""", end


def _scaled_sql(s: int) -> str:
    """CTEs of the confidence at 1/s of the size (s is 2 or 4) and of it brought back to size."""
    inner = f"({s // 2 - 1}, {s // 2})"
    at = lambda c, n: f"greatest(least(floor((p.{c} + 0.5e0) / {s} - 0.5e0) + {c}{c}, {n // s - 1}), 0)"
    part = lambda c: f"CASE WHEN {c}{c} = 1 THEN ((p.{c} + 0.5e0) / {s} - 0.5e0) - floor((p.{c} + 0.5e0) / {s} - 0.5e0) ELSE 1 - ((p.{c} + 0.5e0) / {s} - 0.5e0) + floor((p.{c} + 0.5e0) / {s} - 0.5e0) END"
    return f"""f{s} AS (SELECT camera_id, frame_idx, y // {s} AS y, x // {s} AS x, floor(avg(light) + 0.5e0) AS v FROM li WHERE y % {s} IN {inner} AND x % {s} IN {inner} GROUP BY ALL),
c{s} AS MATERIALIZED (SELECT camera_id, y, x, 1 / (1 + exp((var_pop(v) - 50) / (50e0 / 3))) AS v FROM f{s} GROUP BY ALL),
u{s} AS (SELECT p.camera_id, p.y, p.x, sum(q.v * ({part('y')}) * ({part('x')})) AS v FROM va p, (SELECT unnest([0, 1]) AS yy) dy, (SELECT unnest([0, 1]) AS xx) dx JOIN c{s} q ON q.camera_id = p.camera_id AND q.y = {at('y', H)} AND q.x = {at('x', W_)} GROUP BY ALL)"""


@query(f"""WITH {P_SQL}, {_scaled_sql(2)}, {_scaled_sql(4)},
al AS (SELECT camera_id, y, x, 1 / (1 + exp((variance - 50) / (50e0 / 3))) AS v FROM va UNION ALL SELECT * FROM u2 UNION ALL SELECT * FROM u4)
SELECT camera_id, y, x, round(avg(v), 6) AS confidence, CASE WHEN avg(v) > 0.5 THEN 255 ELSE 0 END AS mask FROM al GROUP BY ALL""")
def multiscale_confidence(spark, sf_dir):
    return rounded(temporal.multiscale(pixels(spark, sf_dir)), "confidence")


_RADIAL = "rm AS MATERIALIZED (SELECT camera_id, y, x, CASE WHEN d > radius THEN 255 ELSE 0 END AS mask FROM di JOIN ra USING (camera_id))"
_VM, _VM_END = _morph_sql("rm", "deed", 15, name="vm")
_VG, _VG_END = _smooth_sql(_VM_END, 5.0, "vg")
_STATIC, _STATIC_END = _refine_sql("sm", 50, "sr")
_FINAL, _FINAL_END = _refine_sql("un", 50, "fr")


@query(f"WITH {R_SQL}, {_RADIAL}, {_VM}, {_VG} SELECT * FROM {_VG_END}")
def vignetting_mask(spark, sf_dir):
    return vignetting.detect(pixels(spark, sf_dir))[0]


@query(f"WITH RECURSIVE {P_SQL}, {_STATIC} SELECT * FROM {_STATIC_END}")
def refined_mask(spark, sf_dir):
    return masks.refine(_static(spark, sf_dir), masks.RefineConfig(min_area=50))


@query(f"""WITH RECURSIVE {R_SQL}, {_RADIAL}, {_VM}, {_VG}, {_STATIC},
un AS MATERIALIZED (SELECT camera_id, y, x, greatest(a.mask, b.mask) AS mask FROM {_STATIC_END} a JOIN {_VG_END} b USING (camera_id, y, x)), {_FINAL} SELECT * FROM {_FINAL_END}""")
def mask_generation(spark, sf_dir):
    return masks.generate(pixels(spark, sf_dir), refine_cfg=masks.RefineConfig(min_area=50))["final"]


# --- the same over tiles: no group holds an image ------------------------------------------------------------------------------------------


@query(ORACLES["fill_holes"])
def fill_holes_tiled(spark, sf_dir):
    return regions.fill_holes(blobs(spark, sf_dir), 16)


@query(ORACLES["remove_small_regions"])
def remove_small_tiled(spark, sf_dir):
    return regions.remove_small(blobs(spark, sf_dir), 8, 16)


@query(ORACLES["mask_close"])
def mask_close_tiled(spark, sf_dir):
    return halo.morphology(_static(spark, sf_dir), "close", size=16)


@query(ORACLES["gaussian_smooth"])
def gaussian_smooth_tiled(spark, sf_dir):
    return halo.smooth_boundary(_static(spark, sf_dir), size=16)


@query(ORACLES["refined_mask"])
def refined_mask_tiled(spark, sf_dir):
    return halo.refine(lineage.stored(_static(spark, sf_dir)), masks.RefineConfig(min_area=50), 16)


# --- sampling -----------------------------------------------------------------------------------------------------------------------


def _lengths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").alias("frame_count"))


@query("""WITH v AS (SELECT doc_id, n_chars AS frame_count, floor(n_chars * 0.1e0)::BIGINT AS lo, floor(n_chars * 0.98e0)::BIGINT AS hi FROM documents),
k AS (SELECT *, unnest(range(greatest(0, least(50, hi - lo)))) AS i FROM v) SELECT doc_id, frame_count, i, floor(lo + i * ((hi - lo)::DOUBLE / least(50, hi - lo)))::BIGINT AS frame_idx FROM k""")
def frame_sample_indices(spark, sf_dir):
    return sampling.uniform_frames(_lengths(spark, sf_dir), 50, 0.1, 0.98)


@query("SELECT doc_id, i.range::INT AS i, floor(i.range * (n_chars - 1) / 15e0)::BIGINT AS frame_idx FROM documents, range(16) i WHERE n_chars > 0")
def clip_sample_indices(spark, sf_dir):
    return sampling.clip_indices(_lengths(spark, sf_dir)).select("doc_id", "i", "frame_idx")


@query(f"WITH {P_SQL} SELECT DISTINCT camera_id, frame_idx FROM px WHERE frame_idx % 3 = 0")
def strided_frames(spark, sf_dir):
    return sampling.strided(pixels(spark, sf_dir), 3).select("camera_id", "frame_idx").distinct()


# --- cameras, discovery, edits ------------------------------------------------------------------------------------------------------

YAML = """
global: {frame_sample_count: 40}
cameras:
  front_wide: {type: wide, has_vignetting: true, expected_ego_regions: [{name: hood, hint_roi: [0, 850, 1920, 230]}]}
  front: {expected_ego_regions: [{name: a, hint_roi: [1, 2]}, {name: b}]}
  rear_wide: {type: wide, resolution: [640, 480], vignetting_config: {threshold: 0.6}}
"""
_CAMS = "c(camera_id, cfg_order, type, has_vignetting, regions) AS (VALUES ('front_wide', 0, 'wide', true, 1), ('front', 1, 'narrow', false, 2), ('rear_wide', 2, 'wide', false, 0))"
VIDEO = "'/v/' || CASE vec_id % 4 WHEN 0 THEN 'front_wide' WHEN 1 THEN 'front' WHEN 2 THEN 'rear_wide' ELSE 'side' END || '_' || vec_id || CASE vec_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.AVI' ELSE '.txt' END"


def camera_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(config.parse(YAML)[0], config.SCHEMA)


def _videos(spark, sf_dir):
    return embeddings(spark, sf_dir).select(F.expr(VIDEO).alias("file_path"))


#: A configuration for each row: some are empty documents, some have no cameras.
SITE = """CASE WHEN vec_id % 11 = 4 THEN '' WHEN vec_id % 7 = 5 THEN 'global: {frame_sample_count: 7}' ELSE concat('global: {variance_threshold: ', vec_id % 9 + 1, ', morphology_kernel_size: ', 2 * label + 1, '}
cameras:
  front_wide: {type: wide, has_vignetting: ', CASE WHEN vec_id % 3 = 0 THEN 'true' ELSE 'false' END, ', expected_ego_regions: [{name: hood, hint_roi: [0, ', vec_id % 100, ', 1920, 230]}]}
  front: {expected_ego_regions: [{name: a, hint_roi: [1, 2]}, {name: b}]}
  rear_wide: {type: wide, resolution: [640, 480], vignetting_config: {threshold: 0.6}}') END"""
_SITES = f"{_CAMS}, s AS (SELECT vec_id AS site, c.camera_id, cfg_order, type, c.camera_id = 'front_wide' AND vec_id % 3 = 0 AS has_vignetting, regions AS n_regions FROM embeddings, c WHERE vec_id % 11 <> 4 AND vec_id % 7 <> 5)"


def _sites(spark, sf_dir):
    return config.read_documents(embeddings(spark, sf_dir).select(F.col("vec_id").alias("site"), F.expr(SITE).alias("text")))


def _site_cameras(spark, sf_dir):
    return config.cameras_of(_sites(spark, sf_dir))


@query(f"WITH {_SITES} SELECT * FROM s")
def cameras(spark, sf_dir):
    return _site_cameras(spark, sf_dir).select("site", "camera_id", "cfg_order", "type", "has_vignetting", F.size("regions").alias("n_regions"))


@query(f"WITH {_SITES} SELECT site, camera_id FROM s WHERE type = 'wide'")
def wide_cameras(spark, sf_dir):
    return cams.wide(_site_cameras(spark, sf_dir)).select("site", "camera_id")


_MATCH = f"{_CAMS}, v AS (SELECT {VIDEO} AS file_path FROM embeddings), m AS (SELECT file_path, arg_min(camera_id, cfg_order) AS camera_id FROM v LEFT JOIN c ON contains(regexp_replace(regexp_extract(file_path, '[^/]+$'), '\\.[^.]*$', ''), camera_id) GROUP BY ALL)"


@query(f"WITH {_MATCH} SELECT * FROM m")
def camera_match(spark, sf_dir):
    return cams.match(_videos(spark, sf_dir), camera_table(spark))


@query(f"WITH {_MATCH} SELECT file_path, coalesce(camera_id, 'front_wide') AS camera_id FROM m")
def camera_fallback(spark, sf_dir):
    c = camera_table(spark)
    return cams.with_fallback(cams.match(_videos(spark, sf_dir), c), c)


@query(f"WITH {_MATCH} SELECT file_path FROM m WHERE camera_id IS NULL")
def batch_unmatched(spark, sf_dir):
    c = camera_table(spark)
    return cams.batch(cams.match(_videos(spark, sf_dir), c), c)[1].select("file_path")


@query(f"SELECT {VIDEO} AS path FROM embeddings WHERE vec_id % 3 < 2")
def discovered_videos(spark, sf_dir):
    return frames.discover_videos(_videos(spark, sf_dir).withColumnRenamed("file_path", "path"))


@query("SELECT doc_id, CASE WHEN doc_id % 30 > 0 THEN n_chars / (doc_id % 30)::DOUBLE ELSE 0e0 END AS duration FROM documents")
def video_duration(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", names.duration(F.col("n_chars"), (F.col("doc_id") % 30).cast("double")).alias("duration"))


@query("WITH l AS (SELECT vec_id % 20 AS mask_id, vec_id AS seq, label FROM embeddings) SELECT mask_id, count(*) - 1 AS strokes, (max(seq) - 20) AS last_seq FROM l GROUP BY ALL")
def edit_history(spark, sf_dir):
    """Each mask's last stroke is undone."""
    log = embeddings(spark, sf_dir).select((F.col("vec_id") % 20).alias("mask_id"), F.col("vec_id").alias("seq"), F.lit("brush").alias("op"), *[F.col("label").alias(c) for c in ("x1", "y1", "x2", "y2", "size")])
    undo = log.groupBy("mask_id").agg((F.max("seq") + 1).alias("seq")).select("mask_id", "seq", F.lit("undo").alias("op"), *[F.lit(0).alias(c) for c in ("x1", "y1", "x2", "y2", "size")])
    return edits.cursor(log.unionByName(undo))


# --- further operators --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_SITES} SELECT site, camera_id FROM s WHERE type = 'narrow'")
def narrow_cameras(spark, sf_dir):
    return cams.narrow(_site_cameras(spark, sf_dir)).select("site", "camera_id")


@query(f"WITH {_SITES} SELECT site, camera_id, has_vignetting AS wanted FROM s")
def vignetting_wanted(spark, sf_dir):
    return cams.vignetting_wanted(_site_cameras(spark, sf_dir), False, ["site"])


@query(f"WITH {P_SQL} SELECT camera_id, y, x, floor(255 / (1 + exp((variance - 50) / (50e0 / 3))))::INT AS confidence FROM va")
def confidence_levels(spark, sf_dir):
    return masks.export_levels(temporal.confidence(_var(spark, sf_dir)), "confidence")


_CLOSE, _CLOSED = _morph_sql("em", "de", 11, "rect")


@query(f"""WITH {R_SQL}, em AS (SELECT camera_id, y, x, CASE WHEN (y < 9 OR y >= {H - 9} OR x < 9 OR x >= {W_ - 9}) AND brightness < centre * 0.6e0 THEN 255 ELSE 0 END AS mask FROM va JOIN mi USING (camera_id)),
{_CLOSE} SELECT * FROM {_CLOSED}""")
def edge_mask_closed(spark, sf_dir):
    return vignetting.edge_mask(_bright(spark, sf_dir), margin=9)


@query(f"WITH {P_SQL} SELECT camera_id, frame_idx, (y // 2)::INT AS y, (x // 2)::INT AS x, round(avg(light), 6) AS v FROM li GROUP BY ALL")
def resized_half(spark, sf_dir):
    all_frames = pixels(spark, sf_dir).select("camera_id", "frame_idx", "y", "x", color.lightness(F.col("b"), F.col("g"), F.col("r")).cast("double").alias("v"))
    return rounded(filters.resize(all_frames, 0.5, ["camera_id", "frame_idx"]), "v")


FRAME_FILE = "'/d/s' || (vec_id % 9) || CASE WHEN vec_id % 2 = 0 THEN '/CMR_GT_Frame/' ELSE '/other/' END || vec_id || CASE WHEN vec_id % 5 = 0 THEN '.JPG' ELSE '.jpg' END"


@query(f"SELECT DISTINCT regexp_extract({FRAME_FILE}, '^(.*/CMR_GT_Frame)/', 1) AS frame_dir FROM embeddings WHERE vec_id % 2 = 0")
def frame_folders(spark, sf_dir):
    return frames.discover_frame_folders(embeddings(spark, sf_dir).select(F.expr(FRAME_FILE).alias("path")))


@query(f"""WITH f AS (SELECT {FRAME_FILE} AS path, vec_id % 5 > 0 AS low FROM embeddings), g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS frame_dir, path, low FROM f),
b AS (SELECT *, bool_or(low) OVER (PARTITION BY frame_dir) AS has FROM g)
SELECT frame_dir, (row_number() OVER (PARTITION BY frame_dir ORDER BY path) - 1)::INT AS frame_idx, path FROM b WHERE low = has""")
def frame_folder_images(spark, sf_dir):
    return frames.frame_folder_images(embeddings(spark, sf_dir).select(F.expr(FRAME_FILE).alias("path")))


@query(f"""WITH {Q_SQL}, l AS (SELECT 0 AS part, s.cluster_id::BIGINT AS at, 'Cluster ' || s.cluster_id || ': ' || s.size || ' rows' || CASE WHEN s.size < 3 THEN ' [MICRO]' ELSE '' END || CASE WHEN vo.cluster_id IS NOT NULL THEN ' [VOID]' ELSE '' END AS line FROM s LEFT JOIN vo USING (cluster_id)
UNION ALL (SELECT 1, vec_id, 'Edge case ' || vec_id || ' in cluster ' || cluster_id FROM ec ORDER BY vec_id LIMIT 20)
UNION ALL SELECT 2, 0, '... and ' || (count(*) - 20) || ' more' FROM ec HAVING count(*) > 20) SELECT * FROM l""")
def report_lines(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return captions.report(clusters.cluster_info(df), clusters.edge_cases(clusters.distances(df)))


_STROKES = [
    "label AS mask_id", "vec_id AS seq", "CASE WHEN vec_id % 3 = 0 THEN 'eraser' ELSE 'brush' END AS op", "CAST(vec_id % 17 AS INT) AS x1",
    "CAST(vec_id * 7 % 20 AS INT) AS y1", "CAST(vec_id % 17 + 3 AS INT) AS x2", "CAST(vec_id * 7 % 20 AS INT) AS y2", "CAST(vec_id % 5 AS INT) AS size",
]


@query(f"""WITH l AS (SELECT {', '.join(_STROKES)} FROM embeddings), k AS (SELECT * FROM l QUALIFY seq < max(seq) OVER (PARTITION BY mask_id)),
g AS (SELECT mask_id, (range // 20)::INT AS y, (range % 20)::INT AS x FROM (SELECT DISTINCT mask_id FROM l), range(400)),
h AS (SELECT g.mask_id, y, x, arg_max(CASE WHEN op = 'brush' THEN 255 ELSE 0 END, seq) AS v FROM g JOIN k ON k.mask_id = g.mask_id
  AND (x - least(greatest(x, x1), x2)) * (x - least(greatest(x, x1), x2)) + (y - y1) * (y - y1) <= (size // 2) * (size // 2) GROUP BY ALL)
SELECT mask_id, y, x, coalesce(v, 0)::INT AS mask FROM g LEFT JOIN h USING (mask_id, y, x)""")
def edited_mask(spark, sf_dir):
    """Each label's strokes on a mask of its own; the last one is undone."""
    log = embeddings(spark, sf_dir).selectExpr(*_STROKES)
    undo = log.groupBy("mask_id").agg((F.max("seq") + 1).alias("seq")).select("mask_id", "seq", F.lit("undo").alias("op"), *[F.lit(0).alias(c) for c in ("x1", "y1", "x2", "y2", "size")])
    blank = log.select("mask_id").distinct().select("mask_id", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("i")).selectExpr("mask_id", "CAST(floor(i / 20e0) AS INT) AS y", "i % 20 AS x", "0 AS mask")
    return edits.apply_edits(blank, edits.live_edits(log.unionByName(undo)))


@query("SELECT 'c' || vec_id AS clip, least(i.range, n - 1)::INT AS frame_idx, i.range::INT AS slot FROM (SELECT vec_id, (vec_id % 4 + 1) AS n FROM embeddings), range(6) i")
def padded_clips(spark, sf_dir):
    clips = embeddings(spark, sf_dir).select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("clip"), F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int"))).alias("frame_idx"))
    return sampling.pad_frames(clips, 6)


@query("SELECT label AS clip, vec_id AS frame_idx FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || label || ':' || vec_id), vec_id) <= 5")
def random_frames(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select(F.col("label").alias("clip"), F.col("vec_id").alias("frame_idx"))
    return sampling.random_frames(rows, 5, seed=42)


_WIDE = ", ".join(f"({i - 8}, {float(w)!r}::DOUBLE)" for i, w in enumerate(filters.gaussian_kernel(2.0)))


@query(f"""WITH {P_SQL}, gk(o, w) AS (VALUES {_WIDE}),
bt AS (SELECT camera_id, y // 8 AS blk_y, x // 8 AS blk_x, least(50e0, 2 * quantile_cont(variance, 0.1)) AS threshold FROM va GROUP BY ALL),
th AS (SELECT va.camera_id, y, x, variance, threshold FROM va JOIN bt ON bt.camera_id = va.camera_id AND blk_y = y // 8 AND blk_x = x // 8),
g1 AS (SELECT p.camera_id, p.y, p.x, sum(q.threshold * w) AS v FROM th p, gk JOIN th q ON q.camera_id = p.camera_id AND q.x = p.x AND q.y = {_REFLECT.format(c='p.y', n=H)} GROUP BY ALL),
g2 AS (SELECT p.camera_id, p.y, p.x, sum(q.v * w) AS v FROM g1 p, gk JOIN g1 q ON q.camera_id = p.camera_id AND q.y = p.y AND q.x = {_REFLECT.format(c='p.x', n=W_)} GROUP BY ALL)
SELECT camera_id, y, x, CASE WHEN variance < v THEN 255 ELSE 0 END AS mask FROM g2 JOIN th USING (camera_id, y, x)""")
def adaptive_mask(spark, sf_dir):
    return temporal.adaptive_static_mask(_var(spark, sf_dir), temporal.TemporalConfig(block_size=8))


@query(ORACLES["adaptive_mask"])
def adaptive_mask_tiled(spark, sf_dir):
    return halo.adaptive_static_mask(_var(spark, sf_dir), temporal.TemporalConfig(block_size=8), 16)


# --- recordings made of a table: they grow with it ------------------------------------------------------------------------------------


def _row_level(ch: int, mod: str) -> str:
    return mod.format(f"CAST(floor(v * 1000e0) AS BIGINT) + {40 * ch}")


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel rows of 8 by 8 pixels for each row of embeddings; labels are the cameras."""
    places = embeddings(spark, sf_dir).select("label", "vec_id", F.posexplode(vectors.doubles(F.col("embedding"))).alias("i", "v"))
    return places.selectExpr("concat('cam', label) AS camera_id", "CAST(vec_id AS INT) AS frame_idx", "CAST(i DIV 8 AS INT) AS y", "i % 8 AS x", *[f"CAST({_row_level(n, 'pmod({}, 256)')} AS INT) AS {c}" for n, c in enumerate("bgr")])


_ROW_LEVELS = ", ".join(f"CAST({_row_level(n, '(({}) % 256 + 256) % 256')} AS INT) AS {c}" for n, c in enumerate("bgr"))
T_SQL = f"""px AS (SELECT 'cam' || label AS camera_id, vec_id::INT AS frame_idx, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, {_ROW_LEVELS} FROM (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
li AS {P_SQL[P_SQL.index("li AS ") + 6 : P_SQL.index("va AS")].rstrip().rstrip(",")}"""
_ANALYSIS = """SELECT camera_id, y, x, round(variance, 6) AS variance, mean_b, mean_g, mean_r, round(brightness, 6) AS brightness, CASE WHEN variance < {t} THEN 255 ELSE 0 END AS mask, round(1 / (1 + exp((variance - {t}) / ({t} / 3e0))), 6) AS confidence
FROM (SELECT camera_id, y, x, (count(*) * sum(light * light) - sum(light) * sum(light))::DOUBLE / (count(*) * count(*)) AS variance, floor(avg(b))::INT AS mean_b, floor(avg(g))::INT AS mean_g, floor(avg(r))::INT AS mean_r, avg(light) / 255 AS brightness FROM li GROUP BY ALL)"""


@query(f"WITH {T_SQL} {_ANALYSIS.format(t=5000)}")
def recording_analysis(spark, sf_dir):
    return rounded(tiles.analyze(tiles.from_pixels(recording(spark, sf_dir), 4), temporal.TemporalConfig(variance_threshold=5000.0)), "variance", "brightness", "confidence")


@query(f"WITH {T_SQL} SELECT camera_id, frame_idx, (y // 5 * 5)::INT AS ty, (x // 5 * 5)::INT AS tx, (max(y) - min(y) + 1)::INT AS h, (max(x) - min(x) + 1)::INT AS w, 8 AS height, 8 AS width, 3 * count(*) AS bytes FROM px GROUP BY ALL")
def recording_tiles(spark, sf_dir):
    cut = tiles.from_pixels(recording(spark, sf_dir), 5)
    return cut.select(*[c for c in cut.columns if c != "data"], F.octet_length("data").cast("long").alias("bytes"))


@query(f"WITH {P_SQL} {_ANALYSIS.format(t=50)}")
def temporal_analysis(spark, sf_dir):
    return rounded(temporal.analyze(pixels(spark, sf_dir)), "variance", "brightness", "confidence")


@query(f"WITH {P_SQL} {_ANALYSIS.format(t=50)}")
def tile_analysis(spark, sf_dir):
    return rounded(tiles.analyze(tiles.from_pixels(pixels(spark, sf_dir), 16)), "variance", "brightness", "confidence")


@query(ORACLES["edge_mask_closed"])
def edge_detection(spark, sf_dir):
    return vignetting.detect_edges(pixels(spark, sf_dir), vignetting.VignettingConfig(edge_margin=9))


@query(f"WITH {P_SQL} SELECT camera_id, (y // 2)::INT AS y, (x // 2)::INT AS x, floor(avg(mask) + 0.5e0)::INT AS mask FROM sm GROUP BY ALL")
def resized_mask(spark, sf_dir):
    static = _static(spark, sf_dir)
    shape = static.groupBy("camera_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return masks.resize_mask(static, shape.select("camera_id", (F.col("h") / 2).alias("h"), (F.col("w") / 2).alias("w")))


@query(f"WITH {T_SQL} SELECT camera_id, frame_idx, y, x, r AS c1, g AS c2, b AS c3 FROM px")
def channel_order(spark, sf_dir):
    df = color.reorder(recording(spark, sf_dir), "rgb")
    return df.select(*df.columns[:4], *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns[4:], 1)])


def _failing(spark, sf_dir):
    return embeddings(spark, sf_dir).selectExpr("concat('cam', label) AS camera_id", "vec_id AS frame_idx", "vec_id % 150 = 144 AS failed")


_FAILING = "fr AS (SELECT 'cam' || label AS camera_id, vec_id AS frame_idx, vec_id % 150 = 144 AS failed FROM embeddings WHERE vec_id % 3 = 0)"


@query(f"WITH {_FAILING}, st AS (SELECT camera_id, min(frame_idx) AS first FROM fr WHERE failed GROUP BY ALL) SELECT camera_id, frame_idx FROM fr LEFT JOIN st USING (camera_id) WHERE first IS NULL OR frame_idx < first")
def strided_videos(spark, sf_dir):
    return sampling.strided(_failing(spark, sf_dir), 3).select("camera_id", "frame_idx")


@query(f"WITH {_FAILING} SELECT camera_id, frame_idx FROM fr WHERE NOT failed")
def strided_images(spark, sf_dir):
    return sampling.strided(_failing(spark, sf_dir), 3, stop_at_failure=False).select("camera_id", "frame_idx")


_NORMAL = ", ".join(f"({i}, '{c}', {m}e0, {d}e0)" for i, (c, m, d) in enumerate(zip("rgb", tensors.MEAN, tensors.STD, strict=True)))


@query(f"""WITH {T_SQL}, k(channel, name, m, d) AS (VALUES {_NORMAL}),
l AS (SELECT camera_id, frame_idx, y, x, unnest(['r', 'g', 'b']) AS name, unnest([r, g, b]) AS v FROM px)
SELECT camera_id, frame_idx, (channel * 64 + y * 8 + x)::INT AS place, round((v / 255e0 - m) / d, 4) AS value FROM l JOIN k USING (name)""")
def frame_tensors(spark, sf_dir):
    """Each frame of the recording as normalised planes, red first."""
    whole = tiles.from_pixels(recording(spark, sf_dir), 8).select("camera_id", "frame_idx", F.col("h").alias("height"), F.col("w").alias("width"), F.lit(3).alias("n_channels"), "data")
    made = tensors.prepare(whole, ["camera_id", "frame_idx"], 8).select("camera_id", "frame_idx", F.posexplode("tensor").alias("place", "value"))
    return made.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(f"WITH {T_SQL} SELECT * FROM px WHERE frame_idx = 77")
def frame_read(spark, sf_dir):
    return sampling.frame_at(recording(spark, sf_dir), 77)


@query("SELECT vec_id, greatest(0, least(2 * vec_id - 100, 300 - 1)) AS shown FROM embeddings")
def frame_navigation(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", sampling.clamp_index(2 * F.col("vec_id") - 100, F.lit(300).cast("long")).alias("shown"))


# --- files and jobs -------------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder in the storage that all machines share."""
    lineage.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/query-{uuid.uuid4().hex}"


@query(f"WITH {P_SQL} SELECT * FROM sm")
def masks_read_back(spark, sf_dir):
    folder = _folder(spark)
    png.write_masks(_static(spark, sf_dir), folder)
    return png.read_masks(spark, folder)


@query(f"WITH {P_SQL} SELECT 'seq' AS camera_id, unnest(range(count(DISTINCT camera_id)))::INT AS frame_idx, {H} AS height, {W_} AS width, 1 AS n_channels, 0e0 AS timestamp_ms FROM sm")
def image_sequence(spark, sf_dir):
    folder = _folder(spark)
    png.write_masks(_static(spark, sf_dir), folder)
    return frames.open_source(spark, folder, True, camera_id="seq").drop("data")


@query("""SELECT vec_id || '.avi' AS name, CASE WHEN vec_id % 9 > 0 THEN label + 12 END AS frame_count, CASE WHEN vec_id % 9 > 0 THEN CASE WHEN vec_id % 4 > 0 THEN 1e6 / (vec_id % 4 * 10000) ELSE 0 END END AS fps,
CASE WHEN vec_id % 9 > 0 THEN 640 + label END AS width, CASE WHEN vec_id % 9 > 0 THEN 480 END AS height, CASE WHEN vec_id % 9 > 0 THEN CASE WHEN vec_id % 4 > 0 THEN (label + 12) / (1e6 / (vec_id % 4 * 10000)) ELSE 0 END END AS duration, vec_id % 9 > 0 AS readable FROM embeddings""")
def video_headers(spark, sf_dir):
    folder = _folder(spark)

    def put(rows):
        store, where = files.store_of(folder)
        store.create_dir(where, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{where}/{r.vec_id}.avi") as f:
                head = struct.pack("<11I", 56, r.vec_id % 4 * 10_000, 0, 0, 0, r.label + 12, 0, 1, 0, 640 + r.label, 480)
                f.write(b"RIFF" + bytes(4) + b"AVI LIST" + bytes(4) + b"hdrlavih" + head if r.vec_id % 9 else b"no video")

    embeddings(spark, sf_dir).select("vec_id", "label").foreachPartition(put)
    found = video.metadata(frames.discover_videos(frames.paths(spark, folder)))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "frame_count", "fps", "width", "height", "duration", F.col("error").isNull().alias("readable"))


@query("""WITH v AS (SELECT vec_id, unnest(range(label + 2)) AS i FROM embeddings WHERE vec_id % 9 > 0), z AS (SELECT *, 4 + (vec_id + i) % 3 * 2 AS size FROM v)
SELECT vec_id || '.avi' AS name, i::INT AS frame_idx, (100 + sum(8 + size) OVER (PARTITION BY vec_id ORDER BY i) - size)::BIGINT AS "offset", size, (i // 4 * 4)::INT AS key_frame, i * 40e0 AS timestamp_ms, true AS readable FROM z
UNION ALL SELECT vec_id || '.avi', NULL, NULL, NULL, NULL, NULL, false FROM embeddings WHERE vec_id % 9 = 0""")
def video_samples(spark, sf_dir):
    """Where the frames lie in a video for each row of the table, some of them broken."""
    folder = _folder(spark)

    def put(rows):
        store, where = files.store_of(folder)
        store.create_dir(where, recursive=True)
        for r in rows:
            body, index = b"movi", b""
            for i in range(r.label + 2):
                size = 4 + (r.vec_id + i) % 3 * 2
                index += b"00dc" + struct.pack("<III", 0x10 if i % 4 == 0 else 0, len(body), size)
                body += b"00dc" + struct.pack("<I", size) + bytes(size)
            head = b"LIST" + struct.pack("<I", 68) + b"hdrlavih" + struct.pack("<II", 56, 40_000) + bytes(52)
            rest = head + b"LIST" + struct.pack("<I", len(body)) + body + b"idx1" + struct.pack("<I", len(index)) + index
            with store.open_output_stream(f"{where}/{r.vec_id}.avi") as f:
                f.write(b"RIFF" + struct.pack("<I", 4 + len(rest)) + b"AVI " + rest if r.vec_id % 9 else b"no video")

    embeddings(spark, sf_dir).select("vec_id", "label").foreachPartition(put)
    found = video.samples(frames.discover_videos(frames.paths(spark, folder)))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "frame_idx", "offset", "size", "key_frame", "timestamp_ms", F.col("error").isNull().alias("readable"))


@query(f"SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'image_sequence' WHEN vec_id % 3 < 2 THEN 'video' END AS kind FROM (SELECT vec_id, {VIDEO} AS p FROM embeddings)")
def source_kinds(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", names.source_kind(F.expr(VIDEO), F.expr("vec_id % 5 = 0")).alias("kind"))


@query(f"SELECT {VIDEO} AS path, 0 AS place FROM embeddings WHERE vec_id % 3 = 0")
def batch_videos(spark, sf_dir):
    return frames.discover_batch(_videos(spark, sf_dir).withColumnRenamed("file_path", "path"), "/v/")


@query("""WITH s AS (SELECT vec_id AS site, vec_id % 7 = 5 AS bare, vec_id % 9 + 1 AS t, 2 * label + 1 AS k FROM embeddings WHERE vec_id % 11 <> 4)
SELECT site, 'file' AS source, CASE WHEN bare THEN 7 ELSE 100 END AS frame_sample_count, CASE WHEN bare THEN 50 ELSE t END::DOUBLE AS variance_threshold, CASE WHEN bare THEN 5 ELSE k END::INT AS kernel_size FROM s
UNION ALL SELECT site, 'override', CASE WHEN bare THEN 7 ELSE 100 END, 12.5, CASE WHEN bare THEN 5 ELSE k END::INT FROM s""")
def global_settings(spark, sf_dir):
    whole = config.globals_of(_sites(spark, sf_dir))
    rows = [mask_jobs.settings_of(whole, threshold).withColumn("source", F.lit(source)) for source, threshold in (("file", None), ("override", 12.5))]
    return rows[0].unionByName(rows[1]).select("site", "source", "frame_sample_count", "variance_threshold", "kernel_size")


def _load_encoder():
    """Tokens of whole numbers, so that their mean is exact; a row whose number is divisible by 11 fails."""

    def encode(row):
        if row[0] % 11 == 0:
            raise ValueError("no such clip")
        return np.floor(np.asarray(row[1], np.float64).reshape(2, -1) * 64)

    return encode


def _encoded(spark, sf_dir):
    return encoders.encode(embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("clip")), _load_encoder, ["vec_id", "clip"], normalize=False)


@query("""WITH t AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda a: floor(64 * a)) AS v, len(embedding) // 2 AS n FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 11 > 0 THEN list_transform(range(n), lambda i: (v[i + 1] + v[i + 1 + n]) / 2) END AS embedding, vec_id % 11 = 0 AS failed FROM t""")
def encoded_clips(spark, sf_dir):
    return _encoded(spark, sf_dir).select("vec_id", vectors.doubles(F.col("embedding")).alias("embedding"), F.col("error").isNotNull().alias("failed"))


@query("SELECT count(*) FILTER (WHERE vec_id % 11 > 0) AS done, count(*) FILTER (WHERE vec_id % 11 = 0) AS failed, (count(*) > 10) AS clustered FROM embeddings")
def encoding_tally(spark, sf_dir):
    encoded = _encoded(spark, sf_dir)
    return spark.createDataFrame([(*curation.tally(encoded), curation.worth_clustering(encoded))], "done long, failed long, clustered boolean")


@query("SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings")
def saved_embeddings(spark, sf_dir):
    path = _folder(spark)
    encoders.save(embeddings(spark, sf_dir).select("vec_id", "embedding"), path)
    return spark.read.parquet(path).select("vec_id", vectors.doubles(F.col("embedding")).alias("embedding"))


@query("SELECT count(*) AS rows_in_clusters, greatest(5, count(*) // 50) AS outliers, 12 AS clusters, true AS unit_length FROM embeddings")
def synthetic_embeddings(spark, sf_dir):
    """As many rows as the table has, and outliers."""
    df = encoders.synthetic(spark, n=embeddings(spark, sf_dir).count(), dim=32, clusters=12)
    inside = F.col("label") < 12
    return df.agg(F.count_if(inside).alias("rows_in_clusters"), F.count_if(~inside).alias("outliers"), F.count_distinct(F.when(inside, F.col("label"))).alias("clusters"), F.every(F.abs(vectors.norm(vectors.doubles(F.col("embedding"))) - 1) < 1e-5).alias("unit_length"))


@query(f"WITH {T_SQL} SELECT camera_id, y, x, CASE WHEN (count(*) * sum(light * light) - sum(light) * sum(light))::DOUBLE / (count(*) * count(*)) < 5000 THEN 255 ELSE 0 END AS mask FROM li GROUP BY ALL")
def streamed_mask(spark, sf_dir):
    """The state of a stream of the recording's pixels after its last file."""
    folder = _folder(spark)
    recording(spark, sf_dir).repartition(4).write.parquet(f"{folder}/pixels")
    running = streaming.running_mask(streaming.stream_pixels(spark, f"{folder}/pixels"), 5000.0)
    put = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/mask")  # noqa: E731 - the state so far, in shared storage
    running.writeStream.outputMode("complete").foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    return spark.read.parquet(f"{folder}/mask")


@query(ORACLES["streamed_mask"])
def streamed_tiles(spark, sf_dir):
    """The same mask from a stream of tiles with keyed state and a file sink."""
    folder = _folder(spark)
    cut = tiles.from_pixels(recording(spark, sf_dir), 4).withColumn("at", F.timestamp_seconds("frame_idx"))
    cut.repartition(4).write.parquet(f"{folder}/tiles")
    sums = tile_state.running_sums(tile_state.stream_tiles(spark, f"{folder}/tiles"), "1000 days")
    tile_state.write_sums(sums, f"{folder}/sums", f"{folder}/state", available_now=True).awaitTermination()
    return tile_state.masks_of(tile_state.latest(spark, f"{folder}/sums"), 5000.0)


def _strokes(spark, sf_dir, *after: str) -> DataFrame:
    """Each mask's strokes, then some other entries."""
    log = embeddings(spark, sf_dir).select((F.col("vec_id") % 5).alias("mask_id"), F.col("vec_id").alias("seq"), F.lit("brush").alias("op"), *[F.lit(0).alias(c) for c in ("x1", "y1", "x2", "y2", "size")])
    last = log.groupBy("mask_id").agg(F.max("seq").alias("last"))
    entries = F.posexplode(F.array(*[F.lit(op) for op in after])).alias("i", "op")
    return log.unionByName(last.select("mask_id", "last", entries).select("mask_id", (F.col("last") + 1 + F.col("i")).alias("seq"), "op", *[F.lit(0).alias(c) for c in ("x1", "y1", "x2", "y2", "size")]))


@query("SELECT vec_id % 5 AS mask_id, count(*) - 2 AS strokes, max(vec_id) - 10 AS last_seq FROM embeddings GROUP BY ALL")
def redone_strokes(spark, sf_dir):
    """Three strokes are undone and one is made again."""
    return edits.cursor(_strokes(spark, sf_dir, "undo", "undo", "undo", "redo"))


@query("SELECT vec_id % 5 AS mask_id, count(*) - 49 AS strokes, max(vec_id) - 245 AS last_seq FROM embeddings GROUP BY ALL")
def reset_strokes(spark, sf_dir):
    """A reset goes back to the oldest of the fifty states that are kept."""
    return edits.cursor(_strokes(spark, sf_dir, "reset"))


@query("SELECT vec_id, trunc((vec_id - 20) / 1.5e0)::INT AS x, trunc((2 * vec_id - 10) / 1.5e0)::INT AS y FROM embeddings")
def screen_places(spark, sf_dir):
    at = edits.to_image(F.col("vec_id"), 2 * F.col("vec_id"), F.lit(1.5), F.lit(20), F.lit(10))
    return embeddings(spark, sf_dir).select("vec_id", at.alias("at")).select("vec_id", "at.x", "at.y")
