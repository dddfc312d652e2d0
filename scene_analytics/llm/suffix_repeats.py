"""Repeated substrings of whole texts, by enhanced suffix arrays and the trees of their common prefixes.

A sparse suffix array: each string of LENGTH bytes picks the SEED bytes in it whose hash is smallest as its anchor, so equal strings
pick the same ones at the same place, and about every 35th byte is an anchor. Anchors with the same seed (its name) come together with
what stands around them, LEFT bytes before and LENGTH bytes from their start on: no string of LENGTH bytes that holds the seed reaches
further. Occurrences with the same surroundings are one class. The classes of a name are sorted by what follows and by what goes
before; a stack scan of the common prefixes of the one order gives the places where left extensions branch, a second scan the
intervals of common prefixes there, and an interval whose left neighbours differ is a maximal repeat, all its occurrences together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, materialize_table, small, split_batches, table, without

LENGTH, SEED = 100, 32
LEFT = LENGTH - SEED
#: A name with more occurrences than about so many is dealt to several tasks.
NAME_ROWS = 8192
#: One in so many documents is looked at to find these names; what is missed is only dealt less evenly.
LOOK = 16
SHARD_ROWS, SCAN_ROWS = 100_000, 20_000
#: Bytes hashed at once, and entries of the suffix arrays compared at once.
CHUNK, ENTRIES = 1 << 20, 200_000
NO_ID = -(1 << 63)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column one after the other, null as empty, and where each begins and the last ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    c = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    at = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _seed_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED bytes from each place on, by doubling."""
    h, base, width = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while width < SEED:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), width * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, names): in each string of LENGTH bytes of one text, the seed of the smallest hash, the leftmost of equal ones.

    A chunk shares LENGTH - 1 bytes with the next, so cuts change nothing.
    """
    whole = np.zeros(len(data) + 1, np.int32)
    long_enough = np.diff(at) >= LENGTH
    np.add.at(whole, at[:-1][long_enough], 1)
    np.add.at(whole, at[1:][long_enough] - LENGTH + 1, -1)
    begins = np.cumsum(whole)[:-1] > 0
    places, names = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for base in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        part = data[base : base + CHUNK + LENGTH - 1]
        h = _seed_hashes(part)
        least, width, seeds = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1, LEFT + 1
        while 2 * width <= seeds:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < seeds:
            least = np.minimum(least[: width - seeds], least[seeds - width :])
        chosen = np.zeros(len(h), bool)
        chosen[(least & np.uint64(0xFFFFFFFF)).astype(np.int64)[begins[base : base + len(least)]]] = True
        found = np.flatnonzero(chosen)
        places.append(found + base)
        names.append(h[found])
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(names)[first].view(np.int64)


def _around(data: np.ndarray, at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, lv, rv) of each place: which text it is in, and how many bytes before it and from it on belong to its surroundings."""
    text = np.searchsorted(at, places, side="right") - 1
    return text, np.minimum(LEFT, places - at[text]), np.minimum(LENGTH, at[text + 1] - places)


def occurrences(docs: DataFrame) -> DataFrame:
    """(name, context long, id long, row int, pos int): the anchors of all texts; `docs` has id, row and text."""
    import pyarrow as pa
    import xxhash

    def run(batches):
        for batch in split_batches(batches, 2):
            data, at = _flat(batch.column(2))
            places, names = anchors(data, at)
            text, lv, rv = _around(data, at, places)
            view, hashed = memoryview(data), xxhash.xxh3_64_intdigest
            begin, end = (places - lv).tolist(), (places + rv).tolist()
            context = np.fromiter((hashed(view[a:b], seed) for a, b, seed in zip(begin, end, (lv * 128 + rv).tolist(), strict=True)), np.uint64, len(places))
            ids = [batch.column(c).to_numpy(zero_copy_only=False)[text] for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(context.view(np.int64)), pa.array(ids[0]), pa.array(ids[1]), pa.array((places - at[text]).astype(np.int32))], names=["name", "context", "id", "row", "pos"])

    return arrow_map(docs.select("id", "row", "text"), run, "name long, context long, id long, row int, pos int")


def stack_scan(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(first, last, value) of every interval of an order in which neighbours i - 1 and i share lcp[i] >= 0; -1 cuts the order.

    The nodes of the tree of common prefixes, inner ones first; lcp[0] is not read.
    """
    out, values, firsts = [], [-1], [0]
    for i in range(1, len(lcp) + 1):
        v = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while values[-1] > v:
            first = firsts.pop()
            out.append((first, i - 1, values.pop()))
        if v > values[-1]:
            values.append(v)
            firsts.append(first)
    return out


def _words(m: np.ndarray) -> list[np.ndarray]:
    """The columns of a matrix of bytes, eight to a number, the most significant first."""
    wide = np.zeros((len(m), -(-m.shape[1] // 8) * 8), np.uint8)
    wide[:, : m.shape[1]] = m
    return list(np.ascontiguousarray(wide).view(">u8").astype(np.uint64).T)


def _common(m: np.ndarray, valid: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes rows a and b of `m` share at their beginning, within what is valid of both."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), ENTRIES):
        x, y = a[i : i + ENTRIES], b[i : i + ENTRIES]
        same = m[x] == m[y]
        out[i : i + ENTRIES] = np.minimum(np.where(same.all(1), m.shape[1], same.argmin(1)), np.minimum(valid[x], valid[y]))
    return out


def _ordered(m: np.ndarray, valid: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the rows of `m` within their groups: the suffix array of what is valid of them, shorter ones first."""
    order = np.lexsort((valid, *_words(m)[::-1], group))
    lcp = np.full(len(order), -1, np.int64)
    together = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
    lcp[together] = _common(m, valid, order[together - 1], order[together])
    return order, lcp


def maximal_repeats(left: np.ndarray, right: np.ndarray, lv: np.ndarray, rv: np.ndarray, group: np.ndarray):
    """(members, first, last, before, after) again and again: members[first[i] : last[i] + 1] are all rows of a maximal repeat that
    reaches `before[i]` bytes to the left of the anchor and `after[i]` from it on, LENGTH at least in all.

    `left` (nearest byte first) and `right` hold the bytes around each anchor, `lv` and `rv` how many of them there are; rows of one
    group have a seed in common. Maximal: not all its rows are followed by the same byte, nor preceded by the same one, as far as
    the surroundings reach.
    """
    n = len(group)
    by_left, left_lcp = _ordered(left, lv, group)
    by_right, right_lcp = _ordered(right, rv, group)
    rank = np.empty(n, np.int64)
    rank[by_right] = np.arange(n)
    nodes = np.array(stack_scan(left_lcp.tolist()), np.int64).reshape(-1, 3)
    size = nodes[:, 1] - nodes[:, 0] + 1
    lot = np.cumsum(size) // ENTRIES
    for k in np.unique(lot):
        first, _, reach = nodes[lot == k].T
        many = size[lot == k]
        node = np.repeat(np.arange(len(many)), many)
        member = by_left[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        member = member[np.argsort(node * n + rank[member], kind="stable")]  # node by node, each sorted by what follows the anchor
        before = reach[node]
        a, b = member[:-1], member[1:]
        lcp = np.full(len(member), -1, np.int64)
        lcp[1:] = right_lcp[rank[b]]
        apart = np.flatnonzero((rank[b] != rank[a] + 1) & (node[1:] == node[:-1]))
        lcp[apart + 1] = _common(right, rv, a[apart], b[apart])
        lcp[1:][(node[1:] != node[:-1]) | (lcp[1:] < LENGTH - before[1:])] = -1
        found = np.array(stack_scan(lcp.tolist()), np.int64).reshape(-1, 3)
        edge = before >= np.minimum(lv[member], LEFT)  # a text's start, or as far as the surroundings reach
        ahead = left[member, np.minimum(before, LEFT - 1)]
        differs = np.zeros(len(member), np.int64)
        differs[1:] = (ahead[1:] != ahead[:-1]) | edge[1:] | edge[:-1]
        differs = np.cumsum(differs)
        found = found[differs[found[:, 1]] > differs[found[:, 0]]]
        yield member, found[:, 0], found[:, 1], before[found[:, 0]], found[:, 2]


def _expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, index) of all indices of the intervals, one after the other."""
    many = last - first + 1
    interval = np.repeat(np.arange(len(many)), many)
    return interval, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def _columns(t, *names):
    return [t[c].to_numpy() for c in names]


def _resolve(t, every: bool):
    """What a shard of occurrences says: whole surroundings seen before (`n` 0), and classes whose surroundings are to be compared."""
    import pyarrow as pa

    name, context, doc, row, pos, salt, parts = _columns(t, "name", "context", "id", "row", "pos", "salt", "parts")
    order = np.lexsort((pos, row, doc, context, name))
    name, context, doc, row, pos, salt, parts = (c[order] for c in (name, context, doc, row, pos, salt, parts))
    new_name = np.ones(len(name), bool)
    new_name[1:] = name[1:] != name[:-1]
    new = new_name.copy()
    new[1:] |= context[1:] != context[:-1]
    start = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    first = start[of]
    later = (doc != doc[first]) | (row != row[first]) | (pos != pos[first])  # a repeated row is no earlier occurrence
    classes = np.bincount(np.cumsum(new_name) - 1, new)[np.cumsum(new_name) - 1]
    members = np.bincount(of, later)[of].astype(np.int64) + 1
    compared = new & ((classes > 1) | (parts > 1) | (every & (members > 1)))
    kept = later | compared
    n = np.where(later, 0, members)[kept]
    first = first[kept]
    arrays = [doc[kept], row[kept], pos[kept], name[kept], salt[kept], parts[kept], n, doc[first], row[first], pos[first]]
    return pa.table(dict(zip(("id", "row", "pos", "name", "salt", "parts", "n", "first_id", "first_row", "first_pos"), map(pa.array, arrays), strict=True)))


RESOLVED = "id long, row int, pos int, name long, salt int, parts int, n long, first_id long, first_row int, first_pos int"


def _dealt(docs: DataFrame, every: bool) -> DataFrame:
    """The anchors of all texts, dealt to tasks by name, names of very many in several parts, and resolved there."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    look = occurrences(docs.where(F.pmod(F.xxhash64("id"), F.lit(LOOK)) == 0)).groupBy("name").agg(F.count("*").alias("n"))
    hot = small(materialize(look.where(F.col("n") >= max(2, NAME_ROWS // LOOK)).select("name", F.ceil(F.col("n") * LOOK / NAME_ROWS).cast("int").alias("parts"))))
    found = occurrences(docs).join(hot, "name", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    found = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    shard = F.pmod(F.xxhash64("name", "salt"), F.lit(max(1, total // (SEED * SHARD_ROWS)))).alias("shard")
    return materialize_table(found.select("*", shard).groupBy("shard").applyInArrow(lambda t: _resolve(t, every), RESOLVED))


def _surroundings(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(name, salt, parts, n, id, row, pos, lv int, around binary) of the classes to compare."""
    import pyarrow as pa

    wanted = resolved.where("n > 0").groupBy("id", "row").agg(F.collect_list(F.struct("pos", "name", "salt", "parts", "n")).alias("at"))  # bounded by the text
    held = docs.join(wanted, ["id", "row"]).select("id", "row", "text", "at")

    def run(batches):
        for batch in split_batches(batches, 2):
            data, at = _flat(batch.column(2))
            lists = batch.column(3)
            many = np.diff(lists.offsets.to_numpy())
            told = dict(zip(("pos", "name", "salt", "parts", "n"), (lists.flatten().field(i) for i in range(5)), strict=True))
            text = np.repeat(np.arange(batch.num_rows), many)
            places = told["pos"].to_numpy() + at[text]
            _, lv, rv = _around(data, at, places)
            around = [data[a:b].tobytes() for a, b in zip((places - lv).tolist(), (places + rv).tolist(), strict=True)]
            ids = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[text]) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([told["name"], told["salt"], told["parts"], told["n"], *ids, told["pos"], pa.array(lv.astype(np.int32)), pa.array(around, pa.binary())], names=["name", "salt", "parts", "n", "id", "row", "pos", "lv", "around"])

    made = arrow_map(held, run, "name long, salt int, parts int, n long, id long, row int, pos int, lv int, around binary")
    shards = max(1, resolved.where("n > 0").count() // SCAN_ROWS)
    return made.withColumn("shard", F.pmod(F.xxhash64("name", "salt"), F.lit(shards)))


class _Shard:
    """The classes of a shard as arrays, repeated rows left out."""

    def __init__(self, t):
        order = np.lexsort((t["pos"].to_numpy(), t["row"].to_numpy(), t["id"].to_numpy()))
        self.name, self.salt, self.parts, self.n, self.doc, self.row, self.pos, lv = (c[order].astype(np.int64) for c in _columns(t, "name", "salt", "parts", "n", "id", "row", "pos", "lv"))
        rows = t["around"].to_pylist()
        rows = [rows[i] for i in order.tolist()]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.doc) != 0) | (np.diff(self.row) != 0) | (np.diff(self.pos) != 0)
        for c in ("name", "salt", "parts", "n", "doc", "row", "pos"):
            setattr(self, c, getattr(self, c)[new])
        self.rows = [rows[i] for i in np.flatnonzero(new).tolist()]
        self.lv, self.rv = lv[new], np.fromiter(map(len, self.rows), np.int64, len(self.rows)) - lv[new]
        wide = np.zeros((len(self.rows), LEFT + LENGTH), np.uint8)  # each anchor at column LEFT; rows are in the order of occurrence
        flat = np.frombuffer(b"".join(self.rows), np.uint8)
        r, i = _expanded(LEFT - self.lv, LEFT + self.rv - 1)
        wide[r, i] = flat
        self.left, self.right = np.ascontiguousarray(wide[:, LEFT - 1 :: -1]), np.ascontiguousarray(wide[:, LEFT:])
        self.wide = wide
        self.group = np.unique(np.stack([self.name, self.salt]), axis=1, return_inverse=True)[1].reshape(-1)

    def repeats(self):
        return maximal_repeats(self.left, self.right, self.lv, self.rv, self.group)


def _windows(s: _Shard):
    """(hash, hash, index, start) of each different string of LENGTH bytes with a seed dealt to several parts: its first occurrence here."""
    rows = np.flatnonzero(s.parts > 1)
    if not len(rows):
        return [np.empty(0, np.int64)] * 4
    found = []
    for t in range(LEFT + 1):  # a string that begins t bytes before its anchor
        mine = rows[(s.lv[rows] >= t) & (s.rv[rows] >= LENGTH - t)]
        words = np.stack(_words(s.wide[mine, LEFT - t : LEFT - t + LENGTH]))
        hashes = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            h = np.full(len(mine), seed ^ t, np.uint64)
            for w in words:
                h = (h ^ w) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
                h *= np.uint64(seed)
                h ^= h >> np.uint64(32)
            hashes.append(h.view(np.int64))
        _, first = np.unique(np.stack([*hashes, s.group[mine]]), axis=1, return_index=True)  # rows are in the order of occurrence
        found.append((hashes[0][first], hashes[1][first], mine[first], s.pos[mine[first]] - t))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


SPANS = "id long, row int, begin int, end int, h1 long, h2 long"


def _covered(t):
    """(id, row, begin, end): what repeats cover around each class that isn't the first of its repeat; strings of split names with h1, h2."""
    import pyarrow as pa

    s = _Shard(t)
    before, after = np.full(len(s.doc), -1, np.int64), np.full(len(s.doc), -1, np.int64)
    for member, first, last, ell, r in s.repeats():
        interval, i = _expanded(first, last)
        m = member[i]
        least = np.full(len(first), len(s.doc))
        np.minimum.at(least, interval, m)  # rows are in the order of occurrence
        later = m != least[interval]
        np.maximum.at(before, m[later], ell[interval[later]])
        np.maximum.at(after, m[later], r[interval[later]])
    hit = np.flatnonzero(after >= 0)
    h1, h2, at, start = _windows(s)
    i = np.concatenate([hit, at])
    begin, end = np.concatenate([s.pos[hit] - before[hit], start]), np.concatenate([s.pos[hit] + after[hit], start + LENGTH])
    nothing = np.arange(len(i)) < len(hit)
    hashes = [pa.array(np.concatenate([np.zeros(len(hit), np.int64), h]), mask=nothing) for h in (h1, h2)]
    return pa.table(dict(zip(("id", "row", "begin", "end", "h1", "h2"), [pa.array(s.doc[i]), pa.array(s.row[i].astype(np.int32)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), *hashes], strict=True)))


def _grouped(t):
    """(h1, h2, length, id, row, pos, start): the occurrences of the maximal repeats of a shard's classes, and classes of several members."""
    import pyarrow as pa
    import xxhash

    s, kinds = _Shard(t), []
    several = np.flatnonzero(s.n > 1)
    for member, first, last, ell, r in [*s.repeats(), (several, np.arange(len(several)), np.arange(len(several)), s.lv[several], s.rv[several])]:
        interval, i = _expanded(first, last)
        m = member[i]
        one = member[first]
        digest = [xxhash.xxh3_128_intdigest(s.wide[x, LEFT - a : LEFT + b].tobytes()) for x, a, b in zip(one.tolist(), ell.tolist(), r.tolist(), strict=True)]
        halves = [np.array([d >> k & (1 << 64) - 1 for d in digest], np.uint64).view(np.int64)[interval] for k in (0, 64)]
        kinds.append((*halves, (ell + r)[interval], s.doc[m], s.row[m], s.pos[m], s.pos[m] - ell[interval]))
    arrays = [np.concatenate(c) for c in zip(*kinds, strict=True)]
    types = [np.int64, np.int64, np.int32, np.int64, np.int32, np.int32, np.int32]
    return pa.table(dict(zip(("h1", "h2", "length", "id", "row", "pos", "start"), [pa.array(a.astype(k)) for a, k in zip(arrays, types, strict=True)], strict=True)))


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """`docs` with id (null: the smallest) and row in front: rows that share an id are told apart, in a fixed order, by a hash of their text."""
    plain = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__raw"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    repeated = not plain.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return plain.withColumn("__at", F.hash("__raw") if repeated else F.lit(0))


def _plain(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("__id").alias("id"), F.col("__at").alias("row"), F.col("__raw").alias("text"))


def repeat_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(`doc_id`, start int, length int, group1, group2 long): all occurrences of every maximal repeat of LENGTH bytes or more.

    A group is named by a hash of its bytes; starts count bytes of UTF-8. Repeats longer than an anchor's surroundings (LEFT + LENGTH
    bytes) are listed as overlapping groups, each maximal within them; of names that are dealt in parts each part lists its own groups.
    Null and short texts and an empty table have no repeats. Rows that share an id and a text are one.
    """
    keyed = _plain(_keyed(docs, text, doc_id))
    resolved = _dealt(keyed, True)
    kinds = "h1 long, h2 long, length int, id long, row int, pos int, start int"
    of = materialize_table(_surroundings(keyed, resolved).groupBy("shard").applyInArrow(_grouped, kinds))
    members = resolved.where("n = 0").select("id", "row", "pos", F.col("first_id").alias("i"), F.col("first_row").alias("r"), F.col("first_pos").alias("p"))
    lead = of.select("h1", "h2", "length", F.col("id").alias("i"), F.col("row").alias("r"), F.col("pos").alias("p"), (F.col("start") - F.col("pos")).alias("by"))
    others = members.join(lead, ["i", "r", "p"]).select("h1", "h2", "length", "id", "row", (F.col("pos") + F.col("by")).alias("start"))
    found = of.drop("pos").unionByName(others).distinct()
    back = F.when(F.col("id") != NO_ID, F.col("id")).alias(doc_id)
    return found.select(back, "start", "length", F.col("h1").alias("group1"), F.col("h2").alias("group2"))


def _merged(begin: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans within 0 to n, overlapping and touching ones as one."""
    begin, end = np.clip(begin, 0, n), np.clip(end, 0, n)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:], len(begin)) - 1]


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` with kept binary, n_bytes, n_removed, n_spans long and spans array<struct<begin, end>> instead of `text`.

    Removed is each byte that a string of LENGTH bytes covers which also starts earlier, in the order of `doc_id` and then of place,
    in the texts as they came in; overlapping occurrences count. `kept` may cut characters. A null text is an empty one. A null id is
    the smallest. Rows that share an id are documents of their own, ordered by a hash of their text; if they share the text too, they
    get the same result. Other columns pass unchanged; columns called like the added ones are replaced. An empty table gives an empty table.

    Occurrences whose whole surroundings stand earlier need no comparison; only the first of each class travels with its bytes. Names
    with very many classes are dealt in parts, each its own suffix array, and the first occurrences of their strings are then
    compared over the parts by hash (128 bits), so nothing is left out and no task holds more than a part.
    """
    import pyarrow as pa

    keyed = _keyed(docs, text, doc_id)
    plain = _plain(keyed)
    resolved = _dealt(plain, False)
    found = materialize_table(_surroundings(plain, resolved).groupBy("shard").applyInArrow(_covered, SPANS))
    strings = found.where("h1 is not null")
    place = F.struct("id", "row", "begin")
    firsts = strings.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    later = strings.join(firsts, ["h1", "h2"]).where(place > F.col("first"))
    whole = resolved.where("n = 0").select("id", "row", (F.col("pos") - LEFT).alias("begin"), (F.col("pos") + LENGTH).alias("end"))
    spans = whole.unionByName(found.where("h1 is null").drop("h1", "h2")).unionByName(later.select("id", "row", "begin", "end"))
    spans = spans.groupBy(F.col("id").alias("__s_id"), F.col("row").alias("__s_at")).agg(F.collect_list(F.struct("begin", "end")).alias("__spans"))  # bounded by the text
    joined = keyed.join(spans, (F.col("__id") == F.col("__s_id")) & (F.col("__at") == F.col("__s_at")), "left")
    added = ["kept", "n_bytes", "n_removed", "n_spans", "spans"]
    keep = without(docs.columns, [*added, text])
    names = [f"c{i}" for i in range(len(keep))]  # whatever the columns are called
    rows = joined.select("__raw", "__spans", *[F.col(f"__row.`{c}`").alias(x) for c, x in zip(keep, names, strict=True)])

    def run(batches):
        for batch in split_batches(batches, 0):
            data, at = _flat(batch.column(0))
            lists = batch.column(1)
            held = lists.flatten()
            begin, end = (held.field(i).to_numpy() for i in (0, 1))
            cut = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            kept, count, size, gone = [], [], np.diff(at), []
            for i in range(batch.num_rows):
                own = data[at[i] : at[i + 1]]
                if cut[i] == cut[i + 1]:
                    kept.append(own.tobytes())
                    gone.append([])
                    count.append(0)
                    continue
                b, e = _merged(begin[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]], len(own))
                edges = [0, *np.stack([b, e], 1).ravel().tolist(), len(own)]
                kept.append(b"".join(own[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
                gone.append([{"begin": x, "end": y} for x, y in zip(b.tolist(), e.tolist(), strict=True)])
                count.append(int((e - b).sum()))
            spans = pa.array(gone, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(kept, pa.binary()), pa.array(size), pa.array(count, pa.int64()), pa.array([len(x) for x in gone], pa.int64()), spans], names=[*names, *added])

    kinds = [f"{x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(keep, names, strict=True)]
    made = arrow_map(rows, run, ", ".join([*kinds, "kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<begin: int, end: int>>"]))
    return made.select(*[F.col(x).alias(c) for c, x in zip(keep, names, strict=True)], *added)


def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; edge cases as in `drop_repeats`."""
    done = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i, i + {LENGTH - 1}) AS w FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d)),
h AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
n AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, true) AS new FROM h),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH - 1} AS z FROM g GROUP BY doc_id, g),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1)::BIGINT AS n_removed, list_concat([0], list(z ORDER BY a)) AS z, list(a ORDER BY a) AS a FROM s GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN c.doc_id IS NULL THEN b ELSE from_hex(array_to_string(list_transform(range(1, len(z) + 1), lambda k: hex(array_slice(b, z[k] + 1, coalesce(a[k], octet_length(b) + 1) - 1))), '')) END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
