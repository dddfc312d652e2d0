import random
import re

import numpy as np
import xxhash

from scene_analytics.llm import simhash
from scene_analytics.llm.components import connected_components


def brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps, bits=3):
    n, root = len(fps), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def documents():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeÉ") for _ in range(4)) for _ in range(60)]
    texts = [None, "", " \n\t", "One", "one two", "one  TWO", "x y z", "word " * 70_000]
    for _ in range(30):
        w = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 1, 4])):
            v = list(w)
            v[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(v))
    return texts + [texts[9]] * 40


def test_fingerprint():
    for t in documents():
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)


def test_triples_reach_every_guaranteed_set_of_positions():
    from itertools import combinations

    for bits in range(6):
        assert all(any(set(t) <= set(same) for t in simhash.triples(bits)) for same in combinations(range(8), 8 - bits))


def test_count_filter_rejects_before_bits_are_counted():
    """Pairs that share three positional bytes meet in a list; those with fewer than five in all are never verified."""
    rng = random.Random(7)
    a = rng.getrandbits(64)
    met = [a ^ sum(rng.randrange(1, 256) << 8 * p for p in rng.sample(range(3, 8), rng.randrange(1, 6))) for _ in range(400)]
    met += [a ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 4))) for _ in range(50)]
    differing = np.array([a ^ x for x in met], np.uint64)
    kept = simhash.tally(differing, 3)
    shared = [sum(d >> 8 * p & 255 == 0 for p in range(8)) for d in differing.tolist()]
    assert kept.tolist() == [i for i, n in enumerate(shared) if n >= 5] and 0 < len(kept) < len(met) - 100
    bits = [d.bit_count() for d in differing.tolist()]
    assert simhash.verified(differing, 3).tolist() == [i for i, n in enumerate(bits) if 0 < n <= 3]
    assert len(simhash.verified(differing, 3)) < len(kept)


def test_query_is_brute_force(spark, tmp_path):
    texts = documents()
    rows = [(1000 - i if i != 4 else None, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fp long").write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op5_simhash(spark, str(tmp_path))
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components([r[0] for r in rows], fps)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted([(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)], key=key)


def test_many_close_fingerprints_in_blocks(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = list({b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(150)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for list_rows, bits in ((16_384, 3), (20, 3), (16_384, 5), (20, 5)):
        links = simhash.link_fingerprints(df, list_rows, bits).collect()
        assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= bits for r in links)
        got = {r.node: r.root for r in connected_components(spark.createDataFrame([(r.u, r.v) for r in links], "u long, v long")).collect()}
        want = brute_components(signed, fps, bits)
        assert [got.get(s, s) for s in signed] == want


def test_components_chain_star_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3), (6, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {5000: 5000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d", "p"), (1, "A b c d", "q"), (1, "A b c d", "q"), (7, "other words here now", "r"), (7, "quite unlike that other", "s"), (None, "lonely text of no id", "t"), (None, "a b c d", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in simhash.drop_near_duplicates(docs).collect() if r.doc_id) == [rows[1], rows[3], rows[4]]
    assert [r.source for r in simhash.drop_near_duplicates(docs).where("doc_id is null").collect()] == ["t"]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(docs.where("source in ('p', 'q', 'r')").dropDuplicates()).count() == 2
