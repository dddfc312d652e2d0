"""Line deduplication, in DataFrame functions only.

Explode normalised lines, hash them, count the documents of each hash, drop the lines of hashes over the threshold and put the
rest together again by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, ascii_lower, hash128, materialize, small, table, without

MIN_DOCS, MIN_CHARS = 10, 1


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id", counts: bool = True) -> DataFrame:
    """The rows of `docs` with `text` cleaned, and with `counts` also `n_lines` (before dropping) and `n_dropped` (long).

    A line counts the distinct ids of the documents that hold it: rows that share an id count once, rows without an id each for
    themselves. Each row keeps its own result; rows that are alike in id and text get the same one. A null text is an empty one:
    one empty line. Lines are compared without outer ASCII white space and with A-Z lower-cased. Other columns pass unchanged,
    whatever their names; only `counts` replace columns called n_lines and n_dropped. An empty table gives an empty table. Only hashes, positions
    and counts of lines are shuffled before the one join that brings the dropped positions to the texts; no step gathers the
    documents of a line.
    """
    raw = F.coalesce(F.col(f"__row.{text}"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = rows.select("__row", F.col(f"__row.{doc_id}").alias("__id"), *hash128(raw, "__t"))
    keys = F.transform(F.split(ascii_lower(raw), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))
    long_enough = F.length("__key") >= min_chars
    held = rows.select("__id", F.explode(F.array_distinct(keys)).alias("__key")).where(long_enough).select("__id", *hash128(F.col("__key"), "__h"))
    # Where an id has several rows its lines are made distinct; all others are so already and need no shuffle for it.
    repeated = materialize(rows.where("__id is not null").groupBy("__id").agg(F.count("*").alias("__n")).where("__n > 1").select("__id"))
    if not repeated.isEmpty():
        repeated = small(repeated)
        held = held.join(repeated, "__id", "left_anti").unionByName(held.distinct().join(repeated, "__id", "left_semi"))
    hot = held.groupBy("__h1", "__h2").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_docs).select("__h1", "__h2")
    hot = small(materialize(hot))
    dropped = (
        rows.select("__id", "__t1", "__t2", F.posexplode(keys).alias("__pos", "__key"))
        .where(long_enough)
        .select("__id", "__t1", "__t2", "__pos", *hash128(F.col("__key"), "__h"))
        .join(hot, ["__h1", "__h2"])
        .groupBy(F.col("__id").alias("__did"), F.col("__t1").alias("__d1"), F.col("__t2").alias("__d2"))
        .agg(F.collect_set("__pos").alias("__gone"))
    )
    same = rows["__id"].eqNullSafe(dropped["__did"]) & (rows["__t1"] == dropped["__d1"]) & (rows["__t2"] == dropped["__d2"])
    lines = F.split(raw, "\n", -1)

    def rest(split):
        kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")

    # The lines are bound to a variable, so that a text is split once and not for each of its lines.
    cleaned = F.when(F.col("__gone").isNull(), raw).otherwise(F.get(F.transform(F.array(lines), rest), F.lit(0)))
    n_dropped = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone"))
    new = {text: cleaned, "n_lines": F.size(lines).cast("long"), "n_dropped": n_dropped.cast("long")}
    added = ["n_lines", "n_dropped"] if counts else []
    others = [F.col(f"__row.`{c}`").alias(c) if c != text else new[text].alias(text) for c in without(docs.columns, added)]
    return rows.join(dropped, same, "left").select(*others, *[new[c].alias(c) for c in added])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; edge cases as in `drop_repeated_lines`."""
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT rid, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM d),
k AS (SELECT rid, doc_id, pos, line, translate(trim(line, {_WS}), '{UPPER}', '{LOWER}') AS key FROM l),
hot AS (
  SELECT key FROM k WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'row ' || rid)) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key
GROUP BY rid
"""
