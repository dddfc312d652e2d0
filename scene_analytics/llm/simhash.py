"""SimHash near-deduplication over a byte-position inverted index with count filtering.

Two 64-bit fingerprints within b bits share at least 8 - b of their 8 positional bytes. The index lists fingerprints under sets of
three positional bytes. Up to 3 bits the 8 triples within the halves reach every such pair, as among any 5 of 8 positions three
lie in the same half; up to 5 bits all 56 triples do. The shared positional bytes of a pair met in a list are tallied; pairs with
the guaranteed minimum or more pass the filter, and only they are verified by their bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, materialize, small, split_batches, table, utf8, without
from .components import connected_components

WORDS, MAX_BITS, SEED = 3, 3, 42
#: A list with more fingerprints is dealt out in blocks that meet pairwise, so that no task holds more than about two of them.
LIST_ROWS = 16_384
#: Shingles hashed at a time; bounds memory on very long texts.
STEP = 1 << 16


def triples(max_bits: int = MAX_BITS) -> list[tuple[int, int, int]]:
    """Sets of three positions, one of which lies in any 8 - max_bits positions: what a pair is sure to share."""
    if max_bits <= 3:
        return [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
    if max_bits <= 5:
        return list(combinations(range(8), 3))
    raise ValueError("more than 5 bits leave fewer than three positional bytes that a pair is sure to share")


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """The fingerprint of a text's UTF-8 bytes, as an unsigned number."""
    import xxhash

    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    width = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(parts) - width + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a:b].tolist(), ends[a + width - 1 : b + width - 1].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, name: str = "fp", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of `docs` and `name` long, the fingerprint's bits. A null or wordless text has 0."""
    import pyarrow as pa

    keep = without(keep if keep is not None else docs.columns, [name])
    inputs, at = carried(docs, keep, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields[: len(keep)]] + [f"`{name}` long"])

    def run(batches):
        for batch in split_batches(batches, at):
            fps = np.array([fingerprint(x, words) for x in utf8(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps, pa.int64())], names=[*keep, name])

    return arrow_map(inputs, run, schema)


def tally(differing: np.ndarray, max_bits: int) -> np.ndarray:
    """Places of the pairs (given by their differing bits) that share the guaranteed minimum of positional bytes."""
    shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return np.flatnonzero(shared >= 8 - max_bits)


def verified(differing: np.ndarray, max_bits: int) -> np.ndarray:
    """Places of the pairs that pass the count filter and then differ in 1 to `max_bits` bits."""
    kept = tally(differing, max_bits)
    bits = np.bitwise_count(differing[kept])
    return kept[(bits > 0) & (bits <= max_bits)]


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that connect what verified pairs connect, fewer than there are fingerprints.

    From a fingerprint, the rest is tallied by shared positional bytes, and what reaches the guaranteed minimum is verified.
    """
    left, links = np.unique(fps.view(np.uint64)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            a = front.pop()
            near = verified(left ^ a, max_bits)
            if len(near):
                found = left[near]
                links += [(int(a.view(np.int64)), int(b)) for b in found.view(np.int64)]
                front += list(found)
                left = np.delete(left, near)
    return links


def link_fingerprints(fps: DataFrame, list_rows: int = LIST_ROWS, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) long: links between distinct fingerprints (column fp) within `max_bits` bits, enough to connect all that are linked.

    Null fingerprints are ignored, repeated ones count once.
    """
    import pyarrow as pa

    one = fps.where("fp is not null").select("fp").distinct()
    byte = lambda p: f"shiftrightunsigned(fp, {8 * p}) & 255"
    keys = [f"({i}L << 24) | (({byte(a)}) << 16) | (({byte(b)}) << 8) | ({byte(c)})" for i, (a, b, c) in enumerate(triples(max_bits))]
    lists = one.select("fp", F.explode(F.array(*[F.expr(k) for k in keys])).alias("key"))
    long = materialize(lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > list_rows).select("key", F.ceil(F.col("n") / list_rows).cast("int").alias("blocks")))
    if long.isEmpty():
        lists = lists.select("key", F.lit(0).alias("part"), "fp")
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, mine) * F.col("blocks") + F.greatest(j, mine))
        lists = lists.join(small(long), "key", "left")
        lists = lists.select("key", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(meets)).alias("part")).select("key", "part", "fp")
    lists = lists.repartition("key", "part").sortWithinPartitions("key", "part")

    def run(batches):
        rest: list[np.ndarray] | None = None

        def links(key, part, fp):
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
            starts = np.concatenate([[0], cut]).astype(np.int64)
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            out = []
            two = starts[sizes == 2]  # most lists that hold a pair hold just one
            near = two[verified(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64), max_bits)]
            out += list(zip(fp[near].tolist(), fp[near + 1].tolist(), strict=True))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                out += spanning_links(np.ascontiguousarray(fp[s : s + n]), max_bits)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield links(*[x[:cut] for x in now])
        if rest is not None:
            yield links(*rest)

    return lists.mapInArrow(run, "u long, v long")


def group_fingerprints(prints: DataFrame, doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of `prints` (doc_id, fp).

    root: smallest fingerprint of the component; component_id: its smallest document id (null if it has none).
    """
    firsts = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("first")))
    roots = connected_components(materialize(link_fingerprints(firsts, max_bits=max_bits)))
    all_roots = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = all_roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(all_roots.join(least, "root").select("fp", "root", "component_id"))


def hexadecimal(c):
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of `docs`.

    Texts whose fingerprints of shingles of `words` words differ in at most `max_bits` bits (5 at most) are linked; component_id is the smallest doc_id that links reach.
    Null and wordless texts have fingerprint zero, linked like any other. Rows with a null id belong to components but don't name
    them; component_id is null only if no row of the component has an id. Repeated rows repeat. An empty table gives an empty one.
    """
    prints = materialize(add_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words, keep=("doc_id",)))
    groups = small(group_fingerprints(prints, max_bits=max_bits))
    return prints.join(groups, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of `docs` for each component, the one with the smallest id; among rows with that id any one of the same text.

    Components are those of `near_duplicate_groups`. Rows without ids are kept only where no row of the component has one, one for
    each component. Null and wordless texts are one component. All columns pass unchanged, whatever their names; an empty table
    gives an empty one.
    """
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    docs = docs.toDF(*names)
    doc_id, text = names[columns.index(doc_id)], names[columns.index(text)]
    prints = materialize(add_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words, keep=("doc_id",)))
    groups = small(group_fingerprints(prints, max_bits=max_bits))
    chosen = prints.join(groups, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.count("*").alias("n"))
    chosen = materialize(chosen)
    rows = docs.join(chosen.select("id"), docs[doc_id].eqNullSafe(F.col("id")), "left_semi")
    if not chosen.where("n > 1 or id is null").isEmpty():
        # Some ids repeat: tell their rows apart by fingerprint, then keep one of each id and fingerprint.
        rows = add_fingerprints(rows, text, words, name="row_fp")
        match = rows[doc_id].eqNullSafe(chosen["id"]) & (rows["row_fp"] == chosen["fp"])
        rows = rows.join(chosen, match, "left_semi").dropDuplicates([doc_id, "row_fp"]).drop("row_fp")
    return rows.toDF(*columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; edge cases as in `near_duplicate_groups`."""
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
