import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from scene_analytics.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def brute(texts, min_docs=10, min_chars=1):
    """Texts of documents of their own."""
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or count[key(x)] < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus():
    rng = random.Random(0)
    common = ["All Rights Reserved", "É cookie  ", "\tmenu\x0b", "x", "É COOKIE", "-", "\x85odd\xa0"]
    texts = [None, "", "\n", "\n\n", " \t ", "menu", "only once"]
    for _ in range(80):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(60)} É\r" for _ in range(rng.randrange(1, 12))]
        texts.append("\n".join(x.upper() if rng.random() < 0.3 else x for x in lines))
    return texts + [texts[10]] * 15 + ["\n".join(f"long {i}" for i in range(30_000)) + "\nmenu"]


def test_brute_force(spark):
    texts = corpus()
    rows = [(i if i % 9 else None, t, "p", 7, "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __pos string, n_lines int, __row string")
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "__pos", "__row", "n_lines", "n_dropped"]
    want = [(r[0], b[0], "p", "r", b[1], b[2]) for r, b in zip(rows, brute(texts), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    for limits in ((3, 1), (10, 5), (1, 1)):
        found = line_dedup.drop_repeated_lines(docs, *limits).select("text", "n_lines", "n_dropped")
        assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(texts, *limits), key=str)


def test_documents_are_distinct_ids(spark, tmp_path):
    """Ten rows of one document hold a line once; the SQL agrees, with null ids and repeated ones."""
    rows = [(1, "a\nb")] * 10 + [(1, "a\nc")] + [(i, "b\nd") for i in range(2, 10)] + [(None, "d\ne")] * 10 + [(20, None), (20, "D \n"), (21, "")]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(rows, schema)
    got = Counter(tuple(r) for r in line_dedup.drop_repeated_lines(docs).collect())
    assert got[(1, "a\nb", 2, 0)] == 10 and got[(1, "a\nc", 2, 0)] == 1 and got[(2, "b", 2, 1)] == 1 and got[(None, "", 2, 2)] == 10 and got[(20, "", 2, 1)] == 1
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_no_python_on_the_way(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = line_dedup.op8_line_dedup(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert df.select(F.col("n_lines")).first()[0] == 1
