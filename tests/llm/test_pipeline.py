import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from scene_analytics.llm import compression_quality, decontaminate, pieces

from .test_decontaminate import brute as brute_leaks
from .test_simhash import brute_components, brute_fingerprint

sentencepiece = pytest.importorskip("sentencepiece")

SPACE = " \t\n\x0b\x0c\r"


def corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("bcdfglmnrst") + rng.choice("aeioué") for _ in range(rng.randrange(1, 4))) for _ in range(2500)]
    weights = [1 / (i + 3) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    items = [(i, text(30)) for i in range(12)]
    docs, labels = [], []
    for i in range(700):
        body = text(rng.randrange(60, 200))
        bad = rng.random() < 0.25
        if bad:
            body = " ".join(w.upper() + "!!" for w in body.split())
        elif i % 9 == 0:
            body = "All rights reserved.\n" + body + "\n  all RIGHTS reserved. "
        elif i % 11 == 0 and docs:
            body = docs[-1][1]
        elif i % 13 == 0:
            body += " " + items[i % 12][1]
        docs.append((i, body, "en", f"src{i % 3}", len(body)))
        labels.append((i, int(not bad), 0))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "tail " + text(4000), "en", "s", 1)]
    return docs, labels, items


def test_pipeline_is_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scorer = compression_quality.trained(spark, table, str(tmp_path))
    rows = [d for d in docs if scorer.score((d[1] or "").encode()) >= 0.7]
    good = {d for d, q, _ in labels if q}
    assert len([d for d in rows if d[0] in good]) > 0.97 * len(good) and len([d for d in rows if d[0] not in good]) < 30

    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    count = Counter(k for d in rows for k in {key(x) for x in (d[1] or "").split("\n")})
    clean = ["\n".join(x for x in (d[1] or "").split("\n") if not key(x) or count[key(x)] < 10) for d in rows]
    rows = [(d[0], t, d[2], d[3], len(t)) for d, t in zip(rows, clean, strict=True)]

    least = brute_components([d[0] for d in rows], [brute_fingerprint(d[1], corpus_pipeline.NEAR_WORDS) for d in rows], corpus_pipeline.NEAR_BITS)
    rows = [d for d, c in zip(rows, least, strict=True) if d[0] == c]
    leaks = {d for d, _ in brute_leaks(items, [d[:3] for d in rows])}
    assert leaks
    rows = [d for d in rows if d[0] not in leaks]

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = []
    for d in rows:
        ids = library.encode(d[1], add_eos=True)
        want.append((*d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [tuple(r)[:8] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


CLASHING = ("leaks", "leaks_", "n_lines", "N_Dropped", "fp", "id", "row_fp", "component_id", "__row", "__id", "__key", "__text", "__text_", "__size", "__score", "score", "c0", "ids", "spans", "u", "root")


def test_stages_keep_all_columns_and_take_empty_tables(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHING)
    full = spark.createDataFrame([(*d, *(d[0] * 100 + i for i in range(len(CLASHING)))) for d in docs[:120] + docs[-3:]], schema)
    for docs in (full, full.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            rows = (docs := stage(spark, docs, str(tmp_path))).collect()
            docs = spark.createDataFrame(rows, docs.schema)
            if k < 4:
                assert docs.schema.simpleString() == full.schema.simpleString(), name
            assert all(r[c] == r.doc_id * 100 + i for r in rows for i, c in enumerate(CLASHING) if not (k == 4 and c in docs.columns[-4:])), name
        assert bool(rows) == (docs.limit(1).count() == 1)


def test_stages_without_labels_and_benchmark(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a text of some words", "en", "s", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [stage(spark, docs, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES] == [0, 1, 1, 1, 1]
    assert decontaminate.MIN_WORDS == 5


def test_run_leaves_one_table(spark, tmp_path):
    from scene_analytics.llm import common

    df = common.materialize_table(spark.range(3))
    common.remove_table(spark.range(3))
    assert df.count() == 3
    common.remove_table(df)
    import os

    assert not os.path.exists(df._stored_at.removeprefix("file:"))
