import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from scene_analytics.llm import filter_audit as fa

SPLIT = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def brute(docs, labels):
    """{(part, order, step): figures} by running each order over the documents."""
    first = {}
    for i, _, text in docs:
        first[text or ""] = min(first.get(text or "", 1 << 63), (1 << 63) - 1 if i is None else i)
    marked = {k: {i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1)}
    seen = []
    for i, lang, text in docs:
        text = text or ""
        w = SPLIT.findall(text)
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), ((1 << 63) - 1 if i is None else i) > first[text]), strict=True) if x}
        seen.append((lang or "", fails, i in marked[0], i in marked[1]))
    out, shapley = {}, {}
    for part in {x[0] for x in seen}:
        mine = [x for x in seen if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in mine)
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus():
    rng = random.Random(1)
    words = ["the", "Cat", "SAT", "on", "mat", "$5", "a|b", "Été", "x#"] + [f"w{i}" for i in range(300)]
    docs = [(0, "en", None), (1, "en", ""), (2, None, " \t\n"), (3, "", "the"), (None, "de", "the"), (3, "en", "the"), (3, "fr", "other row of an id")]
    for i in range(4, 120):
        text = rng.choice([" ", "\n", "\x0b\t"]).join(rng.choice(words[: rng.choice([9, 40, 309])]) for _ in range(rng.choice([1, 150, 199, 200, 201, 400])))
        docs.append((i, rng.choice(["en", "de", None]), text))
    docs += [(200 + i, rng.choice(["en", "es"]), docs[20][2]) for i in range(60)] + [(400, "en", " ".join(f"z{i}" for i in range(60_000)))]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260, 2)] + [(6, 1, 0), (6, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


SCHEMA, LABELS = "doc_id long, lang string, text string", "doc_id long, quality int, toxic int"


def found(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


def run(spark, docs, labels):
    rows = fa.flagged(spark.createDataFrame(docs, SCHEMA).withColumn("N", F.lit(1)).withColumn("good", F.lit("x")), spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("y")))
    return fa.audit(rows, ["fA", "fB", "fC", "fD", "fE"], "part", "n", ["good", "toxic"])


def test_every_order_against_brute_force(spark):
    docs, labels = corpus()
    got, want = found(run(spark, docs, labels)), brute(docs, labels)
    assert len(want) == 5 * 600 and got == want


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    docs, _ = corpus()
    assert found(run(spark, docs, [])) == brute(docs, [])


def test_other_flags_and_limits(spark):
    rows = spark.createDataFrame([("p", True, False, 3), ("p", True, True, 2), ("p", False, False, 5), ("q", False, True, 1)], "part string, x boolean, y boolean, n long")
    got = found(fa.audit(rows, ["x", "y"], "part", "n", []))
    assert got["p", "xy", 1] == (5, 5, 0, 3, 5 + 3) and got["p", "xy", 2] == (5, 0, 2, 0, 2) and got["q", "yx", 1] == (0, 1, 0, 1, 2)
    with pytest.raises(ValueError):
        fa.audit(rows, [], "part", "n", [])
    with pytest.raises(ValueError):
        fa.audit(rows, ["x"] * 8, "part", "n", [])
