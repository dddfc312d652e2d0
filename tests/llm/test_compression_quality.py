import random
import zlib

import numpy as np

from scene_analytics.llm import compression_quality as cq


def test_fit_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    a, b = cq.fit_logistic(x, y)
    assert abs(a - 2) < 0.1 and abs(b + 1) < 0.1
    assert cq.fit_logistic(x, 1 - y)[0] == 0


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1600):
        bad = rng.random() < 0.3
        w = rng.choices(words, k=rng.randrange(30, 200))
        docs.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), i % 7))
        labels.append((i, int(not bad), 0))
    docs += [(2000, None, 0), (2001, "", 0), (None, "no id here", 0), (5, docs[5][1], 0), (2002, "long " * 60_000, 0)]
    labels += [(2003, 1, 0), (None, 1, 0), (2000, None, 0), (7, None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cq.op9_compression_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {d: q for d, q, _ in labels if q is not None}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(test) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    scorer = cq.train(docs, labels)
    assert cq.score_documents(docs, scorer).first().score == 0.5
    assert cq.score_documents(docs.limit(0), scorer).count() == 0
    one = cq.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert 0 < cq.score_documents(docs, one).first().score < 1


def test_long_texts_teach(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs = [(i, " ".join(x.upper() if i % 2 else x for x in rng.choices(words, k=900))) for i in range(60)]
    labels = [(i, 1 - i % 2) for i in range(60)]
    scorer = cq.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert scorer.good and scorer.bad and scorer.slope > 0
    assert all((scorer.score(t.encode()) >= 0.7) == (i % 2 == 0) for i, t in docs)
