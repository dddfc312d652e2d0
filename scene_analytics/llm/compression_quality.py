"""Quality by compression: a text is good as far as a dictionary of good texts compresses it better than one of bad texts does.

Two zstandard dictionaries hold labelled texts, whole ones, good and bad. The feature is the difference of the two compressed
sizes divided by the text's size; a logistic curve fitted to other labelled texts makes it a probability.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, materialize, small, split_batches, table, utf8, without

#: The fit's bounds: labelled texts of each class that are looked at, of any length, and the bytes of a dictionary. What a
#: dictionary doesn't take, calibrates.
FIT_TEXTS, DICTIONARY_BYTES = 2000, 700_000
LEVEL, THRESHOLD = 9, 0.7
#: Added to a text's size, so that a few bytes don't decide.
PAD = 32


class CompressionScorer:
    """Scores UTF-8 texts; holds the two dictionaries and the calibration."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 1.0, offset: float = 0.0) -> None:
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset
        self._made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _compressors(self):
        import zstandard

        if self._made is None:
            made = []
            for content in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d))
            self._made = made
        return self._made

    def feature(self, data: bytes) -> float:
        """Bytes that the good dictionary saves over the bad one, for each byte of the text."""
        good, bad = self._compressors()
        return (len(bad.compress(data)) - len(good.compress(data))) / (len(data) + PAD)

    def score(self, data: bytes) -> float:
        """Probability of label 1."""
        x = self.slope * self.feature(data) + self.offset
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (never negative) and offset of the curve of largest likelihood, by Newton's method, lightly damped."""
    scale = max(float(np.std(x)), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return (w[0] / scale, float(w[1])) if w[0] > 0 else (0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> CompressionScorer:
    """A scorer fitted on at most FIT_TEXTS texts of each class, those whose ids have the smallest hashes.

    Rows without a text, an id or a label of 0 or 1 teach nothing. An id with several rows or
    labels counts each pair. If a class has no text its dictionary is empty; without any, every score is one half.
    """
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    sized = docs.where(F.octet_length(text) > 0).select(F.col(doc_id).alias("__id"), F.octet_length(text).alias("__size"))
    usable = materialize(marked.join(sized, "__id").distinct())
    draw = F.xxhash64(F.col("__id").cast("string"))
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("__label") == y).orderBy(draw, "__id", "__size").limit(FIT_TEXTS)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen.withColumn("__draw", draw))
    got = sorted(chosen.collect(), key=lambda r: (r["__draw"], str(r["__id"]), r["__size"]))
    # Both dictionaries are of one size, at most two thirds of what the smaller class has; the rest fits the curve.
    size = min(DICTIONARY_BYTES, *(2 * sum(r["__size"] for r in got if r["__label"] == y) // 3 for y in (0, 1)))
    picked = []
    for y in (0, 1):
        total = 0
        for r in (r for r in got if r["__label"] == y):
            if total >= size:
                break
            picked.append((r["__id"], y, r["__size"], size - total))
            total += r["__size"]
    keys = ["__id", "__label", "__size"]
    taken = docs.sparkSession.createDataFrame(picked, chosen.select(*keys).withColumn("__room", F.lit(0)).schema)
    full = docs.where(F.octet_length(text) > 0).select(F.col(doc_id).alias("__key"), F.octet_length(text).alias("__size"), F.col(text).alias("__text"))

    def texts_of(part: DataFrame) -> DataFrame:
        return full.join(small(part), (F.col("__key") == part["__id"]) & (full["__size"] == part["__size"])).drop(full["__size"])

    # A longer text's beginning fills what room is left.
    words = texts_of(taken).select("__label", draw.alias("__draw"), F.expr("left(__text, __room)").alias("__text")).toArrow().sort_by([("__draw", "ascending")])
    kept: list[list[bytes]] = [[], []]
    for y, t in zip(words["__label"].to_pylist(), words["__text"].to_pylist(), strict=True):
        kept[y].append(t.encode())
    scorer = CompressionScorer(*(b"\n".join(kept[y])[: DICTIONARY_BYTES + FIT_TEXTS] for y in (1, 0)))
    # Texts that calibrate stay where they are, however long; their features come.
    rest = texts_of(materialize(chosen.join(taken, keys, "left_anti").select(*keys)))
    rated = score_documents(rest, scorer, text="__text", keep=("__label",), name="__x", feature=True).toArrow()
    x, y = rated["__x"].to_numpy(), rated["__label"].to_numpy().astype(float)
    if len(x):
        scorer.slope, scorer.offset = fit_logistic(x, y)
    else:
        scorer.slope = 0.0
    if len(y) and 0 < y.sum() < len(y):
        # The classes were drawn alike; odds move to those of all usable labels.
        n = {r["__label"]: r["count"] for r in usable.groupBy("__label").count().collect()}
        scorer.offset += math.log(n[1] / n[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return scorer


def score_documents(docs: DataFrame, scorer: CompressionScorer, text: str = "text", keep: tuple[str, ...] | None = None, name: str = "score", feature: bool = False) -> DataFrame:
    """The columns `keep` (default: all) of `docs` and `name` double in 0..1; higher: label 1 is likelier. With `feature` it is the feature.

    Null texts are scored as empty ones. Texts are compressed whole. Nothing but the text is looked at; equal texts score alike,
    rows with null or repeated ids too. A kept column called `name`, in whatever case, is replaced; an empty table gives an empty one.
    """
    import pyarrow as pa

    keep = without(keep if keep is not None else docs.columns, [name])
    inputs, at = carried(docs, keep, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields[: len(keep)]] + [f"`{name}` double"])
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # a few times DICTIONARY_BYTES

    def run(batches):
        s = shared.value
        for batch in split_batches(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([(s.feature if feature else s.score)(x) for x in utf8(batch.column(at))], pa.float64())], names=[*keep, name])

    return arrow_map(inputs, run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from. A null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> CompressionScorer:
    return train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out()))


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; edge cases as in `train` and `score_documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, trained(spark, docs, sf_dir), keep=("doc_id",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
