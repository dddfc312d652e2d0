"""A training corpus in five stages, each a DataFrame to a DataFrame; the next stage reads what the one before has written.

Quality keeps what the compression classifier accepts; lines repeated over documents go; of near copies one stays; documents that
hold benchmark items go; what is left is encoded to pieces. Stages pass on the columns of documents, whatever their names, and take
empty tables; the last one adds its own columns, which replace others of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_analytics.llm import compression_quality, decontaminate, line_dedup, pieces, simhash
from scene_analytics.llm.common import fresh, materialize_table, remove_table, table

#: Near copies: shingles of so many words, and fingerprints of 64 bits that differ in so many at most (0.92 of them alike).
NEAR_WORDS, NEAR_BITS = 5, 5


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored as empty ones; without labels every score is one half and nothing stays."""
    scorer = compression_quality.trained(spark, docs, sf_dir)
    score = fresh("score", docs.columns)
    return compression_quality.score_documents(docs, scorer, name=score).where(F.col(score) >= compression_quality.THRESHOLD).drop(score)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text. Null texts become empty ones; documents of which no line is left stay, empty."""
    kept = line_dedup.drop_repeated_lines(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest id stays; wordless texts are one component."""
    return simhash.drop_near_duplicates(docs, words=NEAR_WORDS, max_bits=NEAR_BITS)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and an empty benchmark leak nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def _pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and the digests of the ids, the decoded text and the spans."""
    return pieces.encode_documents(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


STAGES = [
    ("quality", _quality),
    ("line_dedup", _lines),
    ("near_copies", _near_copies),
    ("decontaminate", _benchmark),
    ("pieces", _pieces),
]

#: SQL has neither the classifier nor XXH64 nor the piece model; tests/llm/test_pipeline.py has a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage is not written; what it reads, the table of the one before, stays below the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = materialize_table(stage(spark, docs, sf_dir))
        remove_table(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
