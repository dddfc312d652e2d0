import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from scene_analytics.llm import brown_lm as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_query_counts_and_base_are_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    words = ["the", "of", "Été", "x1", "né,"] + ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts = [None, "", " \n", "only", "THE the The", "zz " * 30_000] + [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=60)) for _ in range(80)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(5000, "same row", 5)] * 3 + [(None, "of no id", 5), (7, "an id again", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    train = Counter(w for d, t, _ in rows if not out(d) for w in tokens(t))
    n, v = sum(train.values()), len(train)

    def want(d, t):
        w = tokens(t)
        return (d, out(d), len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))

    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    expect = sorted((want(d, t) for d, t, _ in rows), key=key)
    seen = []
    for known in (lm.KNOWN_WORDS, 40):  # with most words met in the join, too
        monkeypatch.setattr(lm.frequent_words, "__defaults__", (known,))
        monkeypatch.setattr(lm.train, "__defaults__", ("text", known, 30, 6))
        got = lm.op10_brown_lm(spark, str(tmp_path)).collect()
        assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=key) == expect
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
        seen.append(got)


def test_class_model_sums_to_one_and_beats_single_words(spark):
    rng = random.Random(4)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    texts = [" ".join(rng.choice(a if j % 2 else b) for j in range(40)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = lm.train(docs, classes=2)
    got = lm.score(docs, model, counts).agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"] + 0.25 * 400 * 40 * math.log10(2)
    assert np.allclose((10**model.step).sum(1), 1)
    groups = {model.cls[model.index[w.encode()]] for w in a}, {model.cls[model.index[w.encode()]] for w in b}
    assert len(groups[0]) == len(groups[1]) == 1 and groups[0] != groups[1]


def zipf(rng, n_words, n_docs, length):
    words = ["".join(rng.choice("abcdeé1.") for _ in range(rng.randrange(1, 7))) for _ in range(n_words)]
    weights = [1 / (i + 1) for i in range(n_words)]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(length))) for _ in range(n_docs)] + ["", None]


def test_every_repeated_word_joins_the_class_of_largest_gain(spark):
    """Contexts and gains by their definitions, for words beyond the clustered ones, known to workers or not."""
    texts = zipf(random.Random(5), 400, 60, 60)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    seen = Counter(w for t in texts for w in (t or "").lower().encode().split())
    for known in (500, 60):
        words, n = lm.frequent_words(lm.word_counts(docs), known)
        clustered = 20
        bigrams = lm.symbol_bigrams(docs, words[:clustered])
        of = lm.exchange(bigrams, clustered, 5)
        k = int(of.max()) + 1
        member = np.eye(k)[of]
        stats = member.T @ bigrams @ member
        got = {bytes(r.word): (r.n, r.cls) for r in lm.place(lm.contexts(docs, words, n, clustered, of), words, stats, 5).collect()}
        place = {w: i for i, w in enumerate(words[:clustered])}
        cls = lambda w: of[-1] if w is None else of[place[w]] if w in place else of[clustered + lm.form(w)]
        beside = {}
        for t in texts:
            w = [None, *(t or "").lower().encode().split(), None]
            for a, b, c in zip(w, w[1:], w[2:], strict=False):
                beside.setdefault(b, []).append((cls(a), cls(c)))

        g = lambda x: x * math.log(max(x, 1))

        def likelihood(f):
            return sum(g(x) for x in f.ravel()) - sum(map(g, f.sum(0))) - sum(map(g, f.sum(1)))

        for w, around in beside.items():
            if w in place or len(around) < 2:
                assert w in place or w not in got or got[w] == (1, None)
                continue
            best = []
            for b in range(5):
                rows, cols = np.zeros(k), np.zeros(k)
                for x, y in around:
                    rows[y] += 1
                    cols[x] += 1
                own = sum(g(stats[b, c] + rows[c]) - g(stats[b, c]) + g(stats[c, b] + cols[c]) - g(stats[c, b]) for c in range(k))
                best.append(own - g(stats[b].sum() + len(around)) + g(stats[b].sum()) - g(stats[:, b].sum() + len(around)) + g(stats[:, b].sum()))
            assert got[w][0] == len(around) == seen[w] and best[got[w][1]] > max(best) - 1e-6


def test_scores_are_brute_force(spark):
    """Transitions and emissions counted anew from every word's class; with most words known to workers, and with few."""
    rng = random.Random(8)
    texts = zipf(rng, 500, 80, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [*texts[:20], "never seen words, é1é1é1 xyzzy", None, "a a a never never", texts[3] + " zz zz never"]
    others = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    split = lambda t: (t or "").lower().encode().split()
    for known in (1000, 40):
        model, placed = lm.train(docs, "text", known, 30, 6)
        count = Counter(w for t in texts for w in split(t))
        cls = {w: model.rare(w) for w in count} | {bytes(r.word): r.cls for r in placed.collect() if r.cls is not None} | {w: int(model.cls[i]) for w, i in model.index.items()}
        assert all((cls[w] < 6) == (n >= 2) for w, n in count.items())
        f = np.zeros((len(model.step), len(model.step)))
        sizes, kinds = np.zeros(len(f)), np.zeros(len(f))
        for t in texts:
            c = [model.end, *(cls[w] for w in split(t)), model.end]
            for a, b in zip(c, c[1:], strict=False):
                f[a, b] += 1
        for w, n in [*count.items(), (None, len(texts))]:
            sizes[model.end if w is None else cls[w]] += n
            kinds[model.end if w is None else cls[w]] += 1
        live = np.array([c in model.forms or kinds[c] > 0 for c in range(len(f))])
        step = (f + 0.5 * live) / (f.sum(1, keepdims=True) + 0.5 * live.sum())
        assert np.allclose(10**model.step, step) and np.allclose(step.sum(1), 1)
        emit = lambda w, c: (count[w] + 0.5) / (sizes[c] + 0.5 * (kinds[c] + (c in model.forms)))
        # Each class's words, and an unseen one of a form's class, have chances that sum to one.
        for c in range(len(f)):
            if live[c] and c != model.end:
                assert abs(sum(emit(w, c) for w in cls if cls[w] == c) + (emit(None, c) if c in model.forms else 0) - 1) < 1e-9
        got = {r.doc_id: r.score for r in lm.score(others, model, placed).collect()}
        for d, t in enumerate(new):
            w = split(t)
            c = [model.end, *(cls.get(x, model.rare(x)) for x in w), model.end]
            want = sum(math.log10(step[a, b]) for a, b in zip(c, c[1:], strict=False)) + sum(math.log10(emit(x, y)) for x, y in zip(w, c[1:], strict=False))
            assert abs(got[d] - want) < 1e-6, (known, d)


def test_words_of_arrays_are_the_contract_s():
    texts = ["", None, "A b", "\x85x\xa0y\u2003z ÄÖ\u0130", " lead  and trail \n", *(f"p{chr(c)}q{chr(c)}{chr(c)}R" for c in range(256))]
    for kind in (pa.string(), pa.large_string()):
        words, text = lm.words_of(pa.array(texts, kind))
        assert [(t, w.decode()) for t, w in zip(text.tolist(), words.to_pylist(), strict=True)] == [(i, w) for i, t in enumerate(texts) for w in tokens(t)[:-1]]
    assert len(lm.words_of(pa.array([], pa.string()))[0]) == 0


def test_forms_of_arrays_are_those_of_words():
    words = [b"a", "é".encode(), b"abc.", b"x" * 40, "straße".encode(), b"1", b"-", "…".encode(), b"ab\x85"]
    assert lm.forms_of(pa.array(words, pa.binary())).tolist() == [lm.form(w) for w in words]
    assert lm.forms_of(pa.array(words, pa.binary()).slice(2, 4)).tolist() == [lm.form(w) for w in words[2:6]] and not len(lm.forms_of(pa.array([], pa.binary())))


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 50, (30, 30))

    def likelihood(of):
        m = np.eye(of.max() + 1)[of]
        f = m.T @ n @ m
        g = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return g(f) - g(f.sum(0)) - g(f.sum(1))

    values = [likelihood(lm.exchange(n, 25, 5, sweeps)) for sweeps in range(6)]
    assert all(y >= x - 1e-6 for x, y in zip(values, values[1:], strict=False)) and values[-1] > values[0]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model, counts = lm.train(docs)
    assert lm.score(docs, model, counts).count() == 0
    r = lm.score(spark.createDataFrame([(1, None)], docs.schema), model, counts).first()
    assert (r.n_tokens, r.n_known, r.base_score) == (1, 0, 0)
