"""What each filter of a chain removes in every order, from one CUBE over failure flags.

A grouping set of the cube selects some flags and the part. Of its rows, the one whose selected flags are all false counts what
survives these filters; every step of every order is then a pair of such subsets, before and after its filter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash128, materialize, table

#: Orders and subsets grow with the factorial of the number of filters, not with the data.
MOST_FLAGS = 7
WORDS_AT_LEAST, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"


def survivors(rows: DataFrame, flags: list[str], part: str, measures: list[str]) -> DataFrame:
    """(part, subset int, and the sum of each measure): what passes all flags whose bits are set in `subset`, zeros included.

    `rows` has boolean flags, a part and whole-numbered measures, none of them null. Rows that are alike in flags and part are added
    up before the cube, so that it expands at most 2 ** len(flags) rows of each part and task.
    """
    n = len(flags)
    alike = rows.groupBy(part, *flags).agg(*[F.sum(m).alias(m) for m in measures])
    # The grouping id has a bit for each column, the first the highest, set where the column is not selected.
    cube = alike.cube(*flags, part).agg(F.grouping_id().alias("__gid"), *[F.sum(m).alias(m) for m in measures])
    passed = ~F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in flags], F.lit(False))
    chosen = cube.where((F.col("__gid").bitwiseAND(F.lit(1)) == 0) & passed)
    bits = [F.when(F.col("__gid").bitwiseAND(F.lit(1 << (n - i))) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(n)]
    subset = bits[0]
    for b in bits[1:]:
        subset = subset + b
    counted = chosen.select(F.col(part), subset.alias("subset"), *measures)
    grid = alike.select(part).distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    return grid.join(counted, [part, "subset"], "left").select(part, "subset", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in measures])


def audit(rows: DataFrame, flags: list[str], part: str, count: str, lost: list[str], names: str | None = None) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included.

    (part, filter_order string, step int from 1, kept, removed, redundant, unique_fails, `<m>_lost` for each measure of `lost`, shapley;
    all long.) A filter removes rows whose flag is true. kept: left after the step; removed: by it; redundant: failing its filter, but
    removed before; unique_fails: failing its filter only; shapley: what its filter removes, added up over all orders. `names` has a
    letter for each flag, by default the flags' own last letters. `rows` may hold a row for each document or sums of many. An empty
    table gives an empty table. Raises ValueError without flags or with more than MOST_FLAGS.
    """
    n = len(flags)
    if not 0 < n <= MOST_FLAGS:
        raise ValueError(f"between 1 and {MOST_FLAGS} filters")
    names = names or "".join(f[-1] for f in flags)
    spark, full = rows.sparkSession, (1 << n) - 1
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[i] for i in order), step, f, before, before | 1 << f, 1 << f, full & ~(1 << f)))
            before |= 1 << f
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter int, before int, after int, single int, others int"))  # n! * n rows
    left = materialize(survivors(rows, flags, part, [count, *lost]).withColumnRenamed(part, "__part"))
    measures = [count, *lost]

    def side(name):
        return left.select("__part", F.col("subset").alias(name), *[F.col(m).alias(f"{name}_{m}") for m in (measures if name in ("before", "after") else [count])])

    whole = left.where("subset = 0").select("__part", F.col(count).alias("all"))
    least = left.where(F.col("subset") == full).select("__part", F.col(count).alias("none"))
    joined = steps.join(side("before"), "before").join(side("after"), ["__part", "after"]).join(side("single"), ["__part", "single"]).join(side("others"), ["__part", "others"]).join(whole, "__part").join(least, "__part")
    removed = F.col(f"before_{count}") - F.col(f"after_{count}")
    made = joined.select(
        "__part", "filter_order", "step", "filter", F.col(f"after_{count}").alias("kept"), removed.alias("removed"),
        (F.col("all") - F.col(f"single_{count}") - removed).alias("redundant"), (F.col(f"others_{count}") - F.col("none")).alias("unique_fails"),
        *[(F.col(f"before_{m}") - F.col(f"after_{m}")).alias(f"{m}_lost") for m in lost],
    )
    shapley = made.groupBy("__part", "filter").agg(F.sum("removed").alias("shapley"))
    return made.join(shapley, ["__part", "filter"]).select(F.col("__part").alias(part), "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in lost], "shapley")


def words(text):
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(part, fA to fE boolean, n, good, toxic long): documents by their failures, alike ones added up.

    A: under WORDS_AT_LEAST words; B: under DISTINCT_PERCENT % of the words distinct; C: over CAPITALS_PERCENT % of the code points in
    A-Z; D: a sign of SIGNS; E: the text of a row with a smaller id, anywhere in the table. A null text is an empty one, a null lang
    the part ''. Rows that share an id and a text do not fail E for each other; a row without an id comes last. A document is good or
    toxic if any row of `labels` with its id says so; ids that are null have no labels. Of a group of copies only counts and the
    smallest id leave a task: copies are alike in all flags but E, so no row meets the others of its group.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("part"), raw.alias("text"))
    split = docs.select("id", "part", "text", words(F.col("text")).alias("w"))
    n = F.size("w")
    rows = split.select(
        "id", "part", *hash128(F.col("text"), "h"),
        (n < WORDS_AT_LEAST).alias("fA"), (100 * F.size(F.array_distinct("w")) < DISTINCT_PERCENT * n).alias("fB"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITALS_PERCENT * F.length("text")).alias("fC"), F.col("text").rlike(SIGNS).alias("fD"),
    )
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(said("quality"), said("toxic"))
    rows = rows.join(marks, "id", "left").select(
        "part", "h1", "h2", "fA", "fB", "fC", "fD", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("id", F.lit((1 << 63) - 1)).alias("id")
    )
    # Copies by part and labels: how many there are, the smallest id and how many rows have it. A text's first id is the smallest of these few.
    kinds = ["part", "good", "toxic"]
    ids = rows.groupBy("h1", "h2", *kinds, "fA", "fB", "fC", "fD", "id").agg(F.count("*").alias("n"))
    groups = ids.groupBy("h1", "h2", *kinds, "fA", "fB", "fC", "fD").agg(F.min(F.struct("id", "n")).alias("first"), F.sum("n").alias("n"))
    firsts = groups.groupBy("h1", "h2").agg(F.min("first.id").alias("least"))
    told = groups.join(firsts, ["h1", "h2"])
    at_first = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    kept = told.select(*kinds, "fA", "fB", "fC", "fD", F.explode(F.array(F.struct(F.lit(False).alias("fE"), at_first.alias("n")), F.struct(F.lit(True).alias("fE"), (F.col("n") - at_first).alias("n")))).alias("e"))
    kept = kept.select("part", "fA", "fB", "fC", "fD", "e.fE", F.col("e.n").alias("n"), (F.col("e.n") * F.col("good")).alias("good"), (F.col("e.n") * F.col("toxic")).alias("toxic")).where("n > 0")
    return kept.groupBy("part", "fA", "fB", "fC", "fD", "fE").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases as in `flagged` and `audit`."""
    rows = flagged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return audit(rows, ["fA", "fB", "fC", "fD", "fE"], "part", "n", ["good", "toxic"])


ORACLE_SQL = f"""
WITH d AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1) AS toxic
  FROM documents),
f AS (
  SELECT part, good, toxic, list_filter([
    CASE WHEN len(w) < {WORDS_AT_LEAST} THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '{SIGNS}') THEN 'D' END,
    CASE WHEN id > min(id) OVER (PARTITION BY text) THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM d),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT *, list_min(list_transform(fails, lambda l: strpos(filter_order, l))) AS gone FROM g, orders),
s AS (SELECT DISTINCT part, filter_order, step, substr(filter_order, step::INT, 1) AS f FROM g, orders, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT s.part, s.filter_order, s.step::INTEGER AS step, s.f,
    coalesce(sum(n) FILTER (WHERE gone IS NULL OR gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE list_contains(fails, f) AND gone < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = [f]), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE gone = step), 0)::BIGINT AS toxic_lost
  FROM s JOIN x ON x.part = s.part AND x.filter_order = s.filter_order GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
