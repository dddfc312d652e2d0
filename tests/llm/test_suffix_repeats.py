import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_analytics.llm import suffix_repeats as sr

SCHEMA = "doc_id long, text string"


def brute(texts, length=100):
    """[(kept, n_removed, n_spans)] for texts in the order of their ids."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        out.append((bytes(x for x, g in zip(b, gone) if not g), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum())))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "né") for b in ("ta", "ru", "") for c in ("n", "s", "x", "")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(70), "x" + prose(18)
    texts = [None, "", "short", "a" * 99, "a" * 100, "a" * 101, "a" * 350, "ab" * 90, "abc\0" * 60, "\0" * 130, "\0" * 131, "xyz" + "\0" * 120, prose(30) + "\0" * 110 + prose(30)]
    for _ in range(25):
        w = passage.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(prose(rng.randrange(30)) + " " + " ".join(w) + " " + prose(rng.randrange(30)))
    for _ in range(15):
        i = rng.randrange(len(line))
        texts.append(prose(20) + line[i:] + line[:i] + prose(20))
    for _ in range(10):
        a, b = rng.sample(range(13, 40), 2)
        texts.append(texts[a][: rng.randrange(200)] + texts[b][rng.randrange(60) :])
    texts += [texts[20]] * 4 + [prose(30) + line * 4 + prose(9) + line, prose(4000) + passage, passage[:99], passage[3:103]]
    return texts


def check(spark, texts, shuffled=True):
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("begin", F.lit("x")).withColumn("kept", F.lit(2))
    got = {r["doc_id"]: r for r in sr.drop_repeats(df).collect()}
    assert len(got) == len(texts) and set(next(iter(got.values())).asDict()) == {"doc_id", "begin", "kept", "n_bytes", "n_removed", "n_spans", "spans"}
    for i, (kept, removed, spans) in enumerate(brute(texts)):
        r, whole = got[i], (texts[i] or "").encode()
        assert (bytes(r["kept"]), r["n_removed"], r["n_spans"], r["n_bytes"]) == (kept, removed, spans, len(whole)), i
        assert sum(e - b for b, e in r["spans"]) == removed


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    check(spark, corpus(seed))


def test_names_dealt_in_parts_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(sr, "NAME_ROWS", 4)
    monkeypatch.setattr(sr, "LOOK", 1)
    monkeypatch.setattr(sr, "SHARD_ROWS", 50)
    monkeypatch.setattr(sr, "SCAN_ROWS", 20)
    check(spark, corpus(2))


def test_cuts_change_nothing(monkeypatch):
    data = np.frombuffer("".join(x or "" for x in corpus(3)).encode(), np.uint8)
    at = np.array([0, 50, 50, 3000, 3099, 3199, len(data)])
    whole = sr.anchors(data, at)
    monkeypatch.setattr(sr, "CHUNK", 257)
    cut = sr.anchors(data, at)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and len(whole[0]) < len(data) / 15
    for a, b in zip(at[:-1], at[1:], strict=True):  # each string of 100 bytes holds a whole seed, its own text's
        for i in range(a, b - 99):
            assert ((whole[0] >= i) & (whole[0] + sr.SEED <= i + 100)).any()


def tree(lcp):
    found = set()
    for i in range(1, len(lcp)):
        for j in range(i, len(lcp)):
            v = min(lcp[i : j + 1])
            if v >= 0 and (i == 1 or lcp[i - 1] < v) and (j + 1 == len(lcp) or lcp[j + 1] < v):
                found.add((i - 1, j, v))
    return found


def test_stack_scan():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 8, 20):
        for _ in range(50):
            lcp = [-1] + [rng.randrange(-1, 4) for _ in range(n - 1)] if n else []
            assert set(sr.stack_scan(lcp)) == tree(lcp)


def repeats_of(texts, reach):
    """{bytes: {(doc, start)}} of all maximal repeats of 100 to `reach` bytes."""
    held = {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        for n in range(100, reach + 1):
            for i in range(len(b) - n + 1):
                held.setdefault(b[i : i + n], []).append((d, i))
    out = {}
    for w, at in held.items():
        if len(at) > 1:
            sides = [[(texts[d].encode()[i - 1] if i else (d, i)) for d, i in at], [(texts[d].encode()[i + len(w)] if i + len(w) < len(texts[d].encode()) else (d, i)) for d, i in at]]
            if all(len(set(s)) > 1 for s in sides):
                out[w] = set(at)
    return out


def test_groups_have_all_occurrences_of_maximal_repeats(spark):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    p = prose(118)
    texts = [prose(40) + p + prose(40), p, prose(9) + p[:110] + prose(30), prose(5) + p[8:] + prose(5), prose(60) + p + prose(1), p[4:104] + prose(200), prose(300), None, p]
    found = {}
    for r in sr.repeat_groups(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect():
        found.setdefault((r["group1"], r["group2"]), set()).add((r["doc_id"], r["start"], r["length"]))
    got = {}
    for members in found.values():
        d, i, n = min(members)
        assert {texts[x].encode()[y : y + z] for x, y, z in members} == {texts[d].encode()[i : i + n]}
        got[texts[d].encode()[i : i + n]] = {(x, y) for x, y, _ in members}
    want = repeats_of(texts, 130)
    assert want and all(got.get(w) == at for w, at in want.items())


def test_empty_and_repeated_rows(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert sr.drop_repeats(empty).count() == 0 and sr.repeat_groups(empty).count() == 0
    rng = random.Random(6)
    t = "".join(rng.choice("abcdefgh") for _ in range(400))
    rows = [(3, t), (3, t), (None, t[:250]), (7, t[200:]), (7, "other"), (None, None)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in sr.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(3, 400, 250), (3, 400, 250), (None, 250, 0), (None, 0, 0), (7, 200, 200), (7, 5, 0)], key=str)
    texts = corpus(7)
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept_sha256"] for r in sr.op12_suffix_repeats(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(k).hexdigest() for i, (k, _, _) in enumerate(brute(texts))}
