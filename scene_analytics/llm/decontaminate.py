"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's terms, weighted by how many passages of the corpus hold them. A distributed
randomised SVD of the benchmark's passages gives a latent space of far fewer dimensions than there are passages: what a document's
window has in common with them remains in it, the words around hardly do. Windows whose cosine with a passage reaches a floor are
candidates for its item; the longest common subsequence of words and a check of the item's answer settle them, by falling cosine.
Items that the space hardly holds, or that are shorter than half a window, are found by an exact bound on counts of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, fresh, materialize, split_batches, table, utf8

#: Words of half a window; windows overlap by half.
BLOCK = 16
OVERSAMPLE, POWER = 16, 2
#: Terms found in more than this share of the corpus's passages don't count for the cosine, save the rarest ones of each item.
COMMON, RAREST = 0.05, 8
#: An item is found where its words' longest common subsequence with the place reaches SURE of them, or LIKELY with the answer; one
#: of fewer than MIN_WORDS words where all of them stand together.
SURE, LIKELY, ANSWER_WORDS, MIN_WORDS = 0.8, 0.6, 4, 5
#: Items of one space, about; spaces whose words are counted, and which are searched, in one pass over the documents.
ITEMS, SPACES = 256, 16
#: Dimensions of a space at most, and passages for each dimension at least.
RANK, PER_DIMENSION = 96, 2
#: A window is a candidate where its cosine with a passage reaches FLOOR and its part along it PART of the passage's own length.
FLOOR, PART = 0.65, 0.2
#: Items of fewer words than a block, or with a passage of which the space holds a smaller share than HELD, are found by the exact bound.
HELD = 0.1

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words(data: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return data.translate(_PLAIN).split()


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel in `a`."""
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for x in b:
        m = place.get(x)
        if m:
            u = s & m
            s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def contains(a: list[int], b: list[int]) -> bool:
    """Whether `b` stands in `a` without a gap."""
    n = len(b)
    return any(a[i : i + n] == b for i in range(len(a) - n + 1) if a[i] == b[0]) if n else False


@dataclass
class Items:
    """A block of benchmark items, the space to find them in, and what settles a match."""

    ids: list
    terms: dict[bytes, int]
    texts: list[list[int]]
    answers: list[list[int]]
    basis: np.ndarray  # terms x rank, weighted; zero rows for terms that don't count
    latent: np.ndarray  # passages x rank, unit length
    length: np.ndarray  # of each passage in the space
    of: np.ndarray  # the item of each passage
    exact: np.ndarray  # items that are found by the bound
    counted: np.ndarray  # terms x exact items, 0 or 1: terms of the item whose words are counted; all its others are taken for found
    need: np.ndarray  # of each exact item: counted words that a place must hold to be LIKELY

    def __post_init__(self) -> None:
        self.members = [frozenset(t) for t in self.texts]
        # Eight items' counts side by side in a number: a block's are at most BLOCK.
        self.packed = np.pad(self.counted, ((0, 0), (0, -len(self.exact) % 8))).view(np.uint64)
        self.reach = np.array([-(-len(self.texts[i]) // BLOCK) for i in self.exact], np.int64)
        self.least = [least_words(len(t)) for t in self.texts]


def least_words(n: int) -> int:
    """How many words of an item of `n` words a place must hold at least, in their order."""
    return n if n < MIN_WORDS else int(np.ceil(LIKELY * n - 1e-9))


def document_frequency(docs: DataFrame, terms: dict[bytes, int], text: str) -> tuple[np.ndarray, int]:
    """In how many passages of BLOCK words each term is found, over all documents, and how many passages there are."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        find, n = shared.value.get, len(shared.value)
        count = np.zeros(n + 1, np.int64)
        for batch in split_batches(batches, 0):
            seen, start = [], 0
            for data in utf8(batch.column(0)):
                ids = np.array([find(w, -1) for w in words(data)], np.int64)
                at = start + np.arange(len(ids)) // BLOCK
                start += -(-len(ids) // BLOCK)
                hit = ids >= 0
                seen.append(at[hit] * n + ids[hit])
            if n:
                count[:n] += np.bincount(np.unique(np.concatenate(seen)) % n, minlength=n)
            count[n] += start
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(count[found], pa.int64())], names=["term", "n"])

    count = np.zeros(len(terms) + 1, np.int64)
    for r in arrow_map(docs.select(text), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        count[r["term"]] = r["n"]
    return count[:-1], int(count[-1])


def randomised_svd(passages: DataFrame, n_terms: int, rank: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the matrix whose rows are `passages` (term array<int>, weight array<double>).

    Each round multiplies by the matrix and its transpose where the rows are, and sums the partial products by term.
    """
    import pyarrow as pa

    width = min(rank + OVERSAMPLE, max(n_terms, 1))
    q = np.random.default_rng(seed).normal(size=(n_terms, width))
    spark = passages.sparkSession
    gram = None
    for step in range(POWER + 1):
        q = np.linalg.qr(q)[0] if n_terms else q
        shared = spark.sparkContext.broadcast(q)

        def run(batches, shared=shared):
            q = shared.value
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w = np.array(w)
                    y = w @ q[t]
                    for i, x in zip(t, w, strict=True):
                        total[i] = total.get(i, 0) + x * y
            at = np.arange(q.shape[1])
            for i, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(i * len(at) + at, pa.int64()), pa.array(v, pa.float64())], names=["cell", "v"])

        got = passages.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        gram = np.zeros(q.size)
        gram[got["cell"].to_numpy()] = got["v"].to_numpy()
        gram = gram.reshape(q.shape)
        if step < POWER:
            q = gram
    if not n_terms:
        return np.zeros((0, rank))
    vectors = np.linalg.eigh(q.T @ gram)[1][:, ::-1][:, :rank]
    return q @ vectors


def bounds(texts: list[list[int]], share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items.counted and Items.need; `share`: of the corpus's passages, those that hold a term.

    No common subsequence is longer than the words of the counted terms at a place and all words of the item's other terms. This
    holds for any choice; counted are the rarest terms, as many as make it least likely (Chernoff) that a place reaches the need.
    """
    counted, need = np.zeros((len(share), len(texts)), np.uint8), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        blocks, least = 2 + 2 * -(-len(t) // BLOCK), least_words(len(t))
        order = sorted(set(t), key=lambda x: (share[x], x))
        needs = least - len(t) + np.cumsum([t.count(x) for x in order])
        expected = np.maximum(np.cumsum(share[order]) * blocks, 1e-9)
        safe = np.maximum(needs, 1)
        chance = np.where((needs >= 1) & (needs > expected), safe * np.log(safe / expected) - safe + expected, -1.0)
        chosen = int(np.argmax(chance)) if chance.max() > 0 else len(order) - 1
        counted[order[: chosen + 1], i], need[i] = 1, needs[chosen]
    return counted, need


def prepare(docs: DataFrame, rows: list, text: str, item_id: str, item_text: str, answer: str | None) -> list[Items]:
    """The spaces of about ITEMS of the benchmark's `rows` each; their terms are counted in one pass over all of `docs`."""
    split = [words((r[item_text] or "").encode()) for r in rows]
    own = [words((r[answer] or "").encode()) if answer else [] for r in rows]
    used = [i for i, w in enumerate(split) if w]
    vocabulary: dict[bytes, int] = {}
    for i in used:
        for w in split[i] + own[i]:
            vocabulary.setdefault(w, len(vocabulary))
    df, total = document_frequency(docs, vocabulary, text)
    spaces = []
    for part in np.array_split(np.array(used, np.int64), max(1, -(-len(used) // ITEMS))) if used else []:
        terms: dict[bytes, int] = {}
        texts = [[terms.setdefault(w, len(terms)) for w in split[i]] for i in part]
        answers = [[terms.setdefault(w, len(terms)) for w in own[i]] or t[-ANSWER_WORDS:] for i, t in zip(part, texts, strict=True)]
        at = np.fromiter((vocabulary[w] for w in terms), np.int64, len(terms))
        spaces.append(space(docs.sparkSession, [rows[i][item_id] for i in part], terms, texts, answers, df[at], total))
    return spaces


def passages_of(t: list[int]) -> list[list[int]]:
    """Half-overlapping stretches of two blocks of an item's words; a short item is one."""
    return [t[i : i + 2 * BLOCK] for i in range(0, max(len(t) - BLOCK, 1), BLOCK)]


def space(spark: SparkSession, ids: list, terms: dict[bytes, int], texts: list[list[int]], answers: list[list[int]], df: np.ndarray, total: int) -> Items:
    """The latent space of some items' passages; `df` of `total` passages of the corpus hold each term."""
    import pyarrow as pa

    idf = np.log((1 + total) / (1 + df)) + 1e-3
    counts = np.zeros(len(terms), bool)
    counts[df <= COMMON * max(total, 1)] = True
    for t in texts:
        counts[sorted(set(t), key=lambda x: (-idf[x], x))[:RAREST]] = True
    idf[~counts] = 0
    cut = [(i, p) for i, t in enumerate(texts) for p in passages_of(t)]
    of = np.array([i for i, _ in cut], np.int64)

    def weighted(batches):
        for b in batches:
            rows = [np.unique([x for x in p if idf[x]], return_counts=True) for t in b.column(0).to_pylist() for p in passages_of(t)]
            yield pa.RecordBatch.from_pydict({"term": pa.array([t.tolist() for t, _ in rows], pa.list_(pa.int32())), "weight": pa.array([(n * idf[t.astype(int)]).tolist() for t, n in rows], pa.list_(pa.float64()))})

    words = spark.createDataFrame([(t,) for t in texts], "words array<int>")
    rank = max(1, min(RANK, len(cut) // PER_DIMENSION))
    basis = randomised_svd(words.mapInArrow(weighted, "term array<int>, weight array<double>"), len(terms), rank) * idf[:, None]
    latent = np.array([basis[p].sum(0) for _, p in cut]).reshape(len(cut), -1)
    length = np.linalg.norm(latent, axis=1)
    whole = np.array([np.sqrt((np.bincount(p, minlength=1)[list(set(p))] ** 2 * idf[list(set(p))] ** 2).sum()) for _, p in cut])
    held = np.ones(len(texts))
    np.minimum.at(held, of, length / np.maximum(whole, 1e-12))
    exact = np.array([i for i, t in enumerate(texts) if held[i] < HELD or len(t) < BLOCK], np.int64)
    latent = latent / np.maximum(length[:, None], 1e-12)
    return Items(ids, terms, texts, answers, basis.astype(np.float32), latent.astype(np.float32), length.astype(np.float32), of, exact, *bounds([texts[i] for i in exact], df / max(total, 1)))


def _counted(items: Items, block: np.ndarray, term: np.ndarray, a: int, b: int, n_blocks: int) -> np.ndarray:
    """(windows a to b) x (exact items): whether the blocks that a place's region touches hold as many words as the item needs.

    Words of a neighbouring text do no harm.
    """
    halo = int(items.reach.max()) + 2
    a0, b0 = max(0, a - halo), min(n_blocks, b + halo)
    lo, hi = np.searchsorted(block, [a0, b0])
    possible = np.zeros((b - a, len(items.exact)), bool)
    if hi == lo:
        return possible
    held = np.zeros((b0 - a0 + 1, len(items.exact)), np.int32)
    at, first = np.unique(block[lo:hi], return_index=True)
    held[at - a0 + 1] = np.add.reduceat(items.packed[term[lo:hi]], first, axis=0).view(np.uint8)[:, : len(items.exact)]
    held = np.cumsum(held, axis=0, dtype=np.int32)
    for r in np.unique(items.reach):
        own, w = np.flatnonzero(items.reach == r), np.arange(a, b)
        mine = np.ascontiguousarray(held[:, own])
        possible[:, own] = mine[np.minimum(w + 2 + r, b0) - a0] - mine[np.maximum(w - r, a0) - a0] >= items.need[own]
    return possible


def _candidates(items: Items, term: np.ndarray, block: np.ndarray, c_term: np.ndarray, c_block: np.ndarray, starts: np.ndarray, last: np.ndarray, n_blocks: int, chunk: int) -> dict[tuple[int, int], list[tuple[float, int]]]:
    """For each (text, item) the windows to be looked at: cosine and word."""
    near: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for a in range(0, n_blocks, chunk):
        b = min(n_blocks, a + chunk)
        sums = np.zeros((b + 1 - a, items.basis.shape[1]), np.float32)
        lo, hi = np.searchsorted(block, [a, b + 1])
        if hi > lo:
            at, first = np.unique(block[lo:hi], return_index=True)
            sums[at - a] = np.add.reduceat(items.basis[term[lo:hi]], first, axis=0)
        window = sums[:-1] + np.where(last[a:b, None], 0, sums[1:])
        size = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-6)
        along = window @ items.latent.T
        at_window, passage = np.nonzero(along >= np.maximum(FLOOR * size[:, None], PART * items.length[None]))
        cosines = along[at_window, passage] / size[at_window]
        pairs: dict[tuple[int, int], float] = {}
        for w, i, cosine in zip(at_window.tolist(), items.of[passage].tolist(), np.round(cosines.astype(float), 4).tolist(), strict=True):
            pairs[w, i] = max(cosine, pairs.get((w, i), -1.0))
        if len(items.exact):
            for w, e in np.argwhere(_counted(items, c_block, c_term, a, b, n_blocks)).tolist():
                i = int(items.exact[e])
                if (w, i) not in pairs:
                    pairs[w, i] = round(float((along[w, items.of == i] / size[w]).max(initial=-1.0)), 4)
        docs_at = np.searchsorted(starts, [a + w for w, _ in pairs], side="right") - 1
        for ((w, i), cosine), doc in zip(pairs.items(), docs_at.tolist(), strict=True):
            near.setdefault((doc, i), []).append((cosine, (a + w - int(starts[doc])) * BLOCK))
    return near


def search(items: Items, texts: list[bytes], chunk: int = 4096) -> list[list[dict]]:
    """For each text the items found in it: item_id, similarity (share of the item's words in sequence), cosine, word (place).

    Of several places that match, the one of largest cosine, to four digits, counts, and of these the first.
    """
    find = items.terms.get
    ids, blocks, starts, n_blocks = [], [], [], 0
    for data in texts:
        x = np.array([find(w, -1) for w in words(data)], np.int64)
        ids.append(x)
        blocks.append(n_blocks + np.arange(len(x)) // BLOCK)
        starts.append(n_blocks)
        n_blocks += -(-len(x) // BLOCK)
    found: list[list[dict]] = [[] for _ in texts]
    if not n_blocks or not items.texts:
        return found
    term, block = np.concatenate(ids), np.concatenate(blocks)
    term, block = term[term >= 0], block[term >= 0]
    counts = items.counted.any(axis=1)[term]
    c_term, c_block = term[counts], block[counts]
    weighs = np.any(items.basis, axis=1)[term]
    term, block = term[weighs], block[weighs]
    starts = np.array(starts)
    last = np.zeros(n_blocks, bool)
    last[[s + -(-len(x) // BLOCK) - 1 for s, x in zip(starts, ids, strict=True) if len(x)]] = True
    near = _candidates(items, term, block, c_term, c_block, starts, last, n_blocks, chunk)
    lists: dict[int, list[int]] = {}
    for (doc, i), places in near.items():
        t, best, n, least = items.texts[i], None, len(items.texts[i]), items.least[i]
        held, spare = items.members[i], n - len(items.members[i])
        mine = lists[doc] if doc in lists else lists.setdefault(doc, ids[doc].tolist())

        def may_reach(lo: int, hi: int) -> bool:
            """No common subsequence is longer than the item's terms that are there at all, and the item's repeats."""
            return len(held.intersection(mine[max(0, lo) : hi])) + spare >= least

        # Neighbouring places are first looked at together.
        runs: list[list[tuple[float, int]]] = []
        for place in sorted(places, key=lambda p: p[1]):
            if not runs or place[1] - runs[-1][0][1] > 4 * BLOCK:
                runs.append([])
            runs[-1].append(place)
        places = [p for run in runs if len(run) == 1 or may_reach(run[0][1] - n, run[-1][1] + 2 * BLOCK + n) for p in run]
        for cosine, at in sorted(places, key=lambda p: (-p[0], p[1])):
            lo, hi = max(0, at - n), at + 2 * BLOCK + n
            if not may_reach(lo, hi):
                continue
            region = mine[lo:hi]
            share = lcs(t, region) / n
            if (contains(region, t) if n < MIN_WORDS else share >= SURE or share >= LIKELY and contains(region, items.answers[i])):
                best = {"item_id": items.ids[i], "similarity": share, "cosine": cosine, "word": at}
                break
        if best:
            found[doc].append(best)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, keep: tuple[str, ...] | None = None, name: str = "leaks") -> DataFrame:
    """The columns `keep` (default: all) of `docs` and `name`: a list of (item_id, similarity, cosine, word), empty for clean rows.

    Null texts are empty; items without words, null ones too, are in no text; items of fewer than MIN_WORDS words are found where
    all of them stand together. Without an `answer` column an item's last
    ANSWER_WORDS words are its answer. Repeated rows repeat, repeated items are each found. Texts are searched whole. A kept
    column called `name`, in whatever case, is replaced. Empty tables of either kind find nothing.
    """
    import pyarrow as pa

    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() != name.lower()]
    spark = docs.sparkSession
    columns = [F.col(item_id), F.col(item_text)] + ([F.col(answer)] if answer else [])
    items = materialize(benchmark.select(*columns))
    passes = max(1, -(-items.count() // (ITEMS * SPACES)))
    dealt = items.select("*", F.pmod(F.xxhash64(item_id, item_text), F.lit(passes)).alias("__pass"))
    kind = items.schema[item_id].dataType.simpleString()
    leak = f"struct<item_id:{kind},similarity:double,cosine:double,word:long>"
    inputs, at = carried(docs, keep, text)
    out = inputs.withColumn(name, F.array().cast(f"array<{leak}>"))
    last = len(inputs.columns)
    for p in range(passes):
        shared = spark.sparkContext.broadcast(prepare(docs, dealt.where(F.col("__pass") == p).collect(), text, item_id, item_text, answer))

        def run(batches, shared=shared, out_names=tuple(out.columns)):
            for batch in split_batches(batches, at, 2 << 20):
                texts = utf8(batch.column(at))
                leaks = batch.column(last).to_pylist()
                for items in shared.value:
                    leaks = [old + new for old, new in zip(leaks, search(items, texts), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(leaks, batch.column(last).type)], names=list(out_names))

        out = arrow_map(out, run, out.schema)
    return out.select(*[f"`{c}`" for c in keep], name)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` in which no benchmark item is found, with all their columns, whatever their names; else as `find_leaks`."""
    name = fresh("leaks", docs.columns)
    return find_leaks(docs, benchmark, text, name=name).where(F.size(name) == 0).drop(name)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each benchmark item found in it; edge cases as in `find_leaks`."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.round("leak.similarity", 6).alias("similarity"), "leak.word")
