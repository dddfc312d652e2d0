"""Language-model scoring with Brown's class-based bigrams.

Exchange clustering gives the most frequent words their classes. Every other word that occurs twice or more is then placed, on the
executors, in the class that its left and right neighbours make likeliest by the same gain; words seen once, and unseen ones, share
classes told by their form. A text's probability is the product of class transitions and word emissions, both smoothed. Words,
contexts and transitions are counted over the whole training part. Workers know the most frequent words (a stated bound); the
other tokens meet their counts and classes in equi joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize_table, remove_table, split_batches, table, utf8

#: Words that every worker knows; words whose classes are found by exchange, which all others are placed among; sweeps at most.
KNOWN_WORDS, CLUSTERED_WORDS, SWEEPS = 300_000, 1024, 12
#: Classes: distinct words to this power, and no fewer than the least number.
CLASS_POWER, LEAST_CLASSES = 0.3, 8
SMOOTH = 0.5
END = b" "  # a space: no word is one
#: Distinct words, or codes of contexts, that a task keeps before it hands its counts on; rows of an Arrow batch.
FLUSH, ROWS = 400_000, 50_000
#: Lots that words are dealt into, for what is shuffled by word.
PARTS = 1 << 14
#: Counts of a context below this one take their gains from a table.
SMALL = 5
FORMS = 20


def form(word: bytes) -> int:
    """The class of a rare word, from its form: length, last character, whether it is all ASCII."""
    last = word[-1]
    return min(len(word) // 3, 4) * 4 + 2 * (last < 128 and not chr(last).isalnum()) + (not word.isascii())


_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def forms_of(words) -> np.ndarray:
    """`form` of each word of an Arrow binary array."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    foreign = np.bitwise_or.reduceat(data[: ends[-1]], ends[:-1]) >= 128
    return np.minimum(np.diff(ends) // 3, 4) * 4 + 2 * _MARK[data[ends[1:] - 1]] + foreign


def words_of(texts) -> tuple:
    """The words of an Arrow array of texts, as an Arrow binary array, and of each word its text. Null texts are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, text = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full).cast(pa.binary()), text.filter(full).to_numpy(zero_copy_only=False)


def held_out(doc_id: str, modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, form int, n long): how often each word, and the end of a text, is found in `docs`; null texts are empty."""
    import pyarrow as pa

    def run(batches):
        held, size, ends = [], 0, 0

        def out():
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            words, n = (t.column(c).combine_chunks() for c in ("word", "n_sum"))
            for s in range(0, len(words), ROWS):
                w = words.slice(s, ROWS)
                yield pa.RecordBatch.from_arrays([w, pa.array(forms_of(w), pa.int32()), n.slice(s, ROWS)], names=["word", "form", "n"])
            held.clear()

        for batch in split_batches(batches, 0):
            found = words_of(batch.column(0))[0].value_counts()
            ends += batch.num_rows
            if len(found):
                held.append(pa.Table.from_arrays([found.field(0), found.field(1)], names=["word", "n"]))
                size += len(found)
            if size >= 5 * FLUSH:
                yield from out()
                size = 0
        if held:
            yield from out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([-1], pa.int32()), pa.array([ends], pa.int64())], names=["word", "form", "n"])

    found = arrow_map(docs.select(text), run, "word binary, form int, n long")
    return found.groupBy("word").agg(F.first("form").alias("form"), F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = KNOWN_WORDS) -> tuple[list[bytes], np.ndarray]:
    """At most `most` of the most frequent words, by falling count, from a histogram of at most a few hundred buckets."""
    bucket = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r[0], r[1]) for r in counts.where("form >= 0").groupBy(bucket).count().collect()), reverse=True)
    total, least = 0, None
    for b, n in histogram:
        if total + n > most:
            break
        total, least = total + n, b
    if least is None:
        return [], np.zeros(0, np.int64)
    got = counts.where("form >= 0").where(bucket >= least).select("word", "n").toArrow()
    rows = sorted(zip(got["n"].to_pylist(), got["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    return [w for _, w in rows], np.array([n for n, _ in rows], np.int64)


class Walker:
    """What a worker knows of words: their numbers and, for each number, its class."""

    def __init__(self, words: list[bytes], cls: np.ndarray, end: int, forms: list[int], guess: bool = False) -> None:
        self.words, self.cls, self.end, self.forms, self.guess = words, cls, end, forms, guess
        self._listed = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_listed": None}

    @property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def rare(self, word: bytes) -> int:
        """The class that a word has if it occurs at most once."""
        return self.forms[form(word)]

    def walk(self, texts) -> Walk:
        """The words of an Arrow array of texts, in a row. One that isn't known has the class -1, or that of its form where the
        walker has to `guess`."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self._listed is None:
            self._listed = pa.array(self.words, pa.binary())
        words, text = words_of(texts)
        size = np.bincount(text, minlength=len(texts))
        ids = pc.fill_null(pc.index_in(words, value_set=self._listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.arange(len(words)) + text + 1
        cls = np.full(len(words) + len(texts) + 1, self.end, np.int64)
        miss = np.flatnonzero(ids < 0)
        tail = words.take(pa.array(miss))
        rare = np.array(self.forms, np.int64)[forms_of(tail)]
        cls[at] = self.cls[ids] if len(self.cls) else -1
        cls[at[miss]] = rare if self.guess else -1
        return Walk(ids, text, at, cls, size, miss, tail, rare)


@dataclass
class Walk:
    """Texts in a row: an end, the first text's words, an end, the second's, and so on, and an end."""

    ids: np.ndarray  # of each word, -1: not known
    text: np.ndarray  # of each word
    at: np.ndarray  # place of each word in the row
    cls: np.ndarray  # of each place
    size: np.ndarray  # words of each text
    miss: np.ndarray  # the words that aren't known
    tail: object  # their spelling, an Arrow array
    rare: np.ndarray  # the class that they have if they occur at most once

    def tail_rows(self) -> tuple[np.ndarray, list]:
        """The texts of rows of TAIL, and the rows: what the words that aren't known have beside them.

        A row for each such word with its neighbours' classes (-1: not known, too), and one for each two of them side by side.
        """
        import pyarrow as pa

        at = self.at[self.miss]
        first = np.flatnonzero(np.diff(at) == 1)
        n, m = len(at), len(first)
        none = np.full(m, -1)
        word = pa.concat_arrays([self.tail, self.tail.take(pa.array(first))])
        second = pa.concat_arrays([pa.nulls(n, pa.binary()), self.tail.take(pa.array(first + 1))])
        numbers = (np.concatenate(x) for x in ((self.rare, self.rare[first]), (np.full(n, -1), self.rare[first + 1]), (self.cls[at - 1], none), (self.cls[at + 1], none)))
        own, own2, before, after = (pa.array(x, pa.int32()) for x in numbers)
        text = self.text[self.miss]
        return np.concatenate([text, text[first]]), [word, own, second, own2, before, after, pa.array(np.ones(n + m, np.int64))]


def symbol_bigrams(docs: DataFrame, words: list[bytes], text: str = "text") -> np.ndarray:
    """Counts [previous, next] over symbols: `words`, then a symbol for each form, then the end; a text starts after an end.

    The matrix has (len(words) + FORMS + 1) squared cells, whatever the size of the corpus; each task sends sums of its cells.
    """
    import pyarrow as pa

    size = len(words) + FORMS + 1
    known = docs.sparkSession.sparkContext.broadcast(Walker(words, np.arange(len(words)), size - 1, list(range(len(words), size - 1)), guess=True))

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in split_batches(batches, 0):
            c = known.value.walk(batch.column(0)).cls
            total += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    got = arrow_map(docs.select(text), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size, np.int64)
    matrix[got["cell"].to_numpy()] = got["n"].to_numpy()
    known.unpersist()
    return matrix.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, movable: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the symbols of `bigrams`: the first `movable` ones are exchanged among `classes`, each other one has its own.

    A sweep moves each symbol to the class that raises the likelihood of the class bigrams most; ties go to the smaller class.
    """
    size = len(bigrams)
    classes = max(1, min(classes, movable)) if movable else 0
    of = np.concatenate([np.arange(movable) % max(classes, 1), classes + np.arange(size - movable)])
    k = classes + size - movable
    n = bigrams.astype(np.float64)
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    f = member.T @ n @ member

    for _ in range(sweeps if classes > 1 else 0):
        moved = 0
        for w in range(movable):
            a = of[w]
            out, into, self_ = n[w] @ member, n[:, w] @ member, n[w, w]
            out[a] -= self_
            into[a] -= self_
            f[a, :] -= out
            f[:, a] -= into
            f[a, a] -= self_
            row, col = f.sum(1) + into, f.sum(0) + out  # wherever the symbol goes, the others keep what they have with it
            base_rows, base_cols = xlogx(f[:classes]), xlogx(f[:, :classes])
            corner = np.arange(classes)
            rows, cols = f[:classes] + out, f[:, :classes] + into[:, None]
            gain = (xlogx(rows) - base_rows).sum(1) + (xlogx(cols) - base_cols).sum(0)
            old = np.diagonal(f)[:classes]
            # the diagonal cell belongs to both and gets all three parts
            gain -= (xlogx(rows[corner, corner]) - xlogx(old)) + (xlogx(cols[corner, corner]) - xlogx(old))
            gain += xlogx(old + out[:classes] + into[:classes] + self_) - xlogx(old)
            gain -= xlogx(row[:classes] + out.sum() + self_) - xlogx(row[:classes])
            gain -= xlogx(col[:classes] + into.sum() + self_) - xlogx(col[:classes])
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else a
            f[b, :] += out
            f[:, b] += into
            f[b, b] += self_
            if b != a:
                member[w, a], member[w, b], of[w] = 0, 1, b
                moved += 1
        if not moved:
            break
    return of


def contexts(docs: DataFrame, words: list[bytes], n: np.ndarray, clustered: int, of: np.ndarray, text: str = "text") -> DataFrame:
    """(part int, word binary, code long, packed binary): what classes stand beside the words beyond the `clustered` ones.

    A known word has no `word`. Its codes are its number times twice the classes, plus the class of the word on its left, or plus the
    number of classes and the class of the word on its right; `packed` holds such codes and then their counts, as longs, once or a
    few times for each task and part. Any other word has a row each time that it is found; its code is the left class times the
    classes plus the right one. Neighbours that aren't clustered count by their form. Known words that occur once are left out. All
    rows of a word have the same part, of PARTS.
    """
    import pyarrow as pa
    import xxhash

    k = int(of.max()) + 1
    forms = of[clustered : clustered + FORMS].tolist()
    cls = np.array([of[i] if i < clustered else forms[form(w)] for i, w in enumerate(words)], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((Walker(words, cls, int(of[-1]), forms, guess=True), (n >= 2) & (np.arange(len(words)) >= clustered)))
    names = ["part", "word", "code", "packed"]

    def run(batches):
        walker, often = shared.value
        codes, held = [], 0

        def known():
            code, count = np.unique(np.concatenate(codes), return_counts=True)
            part = code // (2 * k) % PARTS
            order = np.argsort(part, kind="stable")
            code, count, part = code[order], count[order], part[order]
            start = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1]) if len(part) else np.zeros(0, np.int64)
            for s in range(0, len(start), 1000):
                lots = [slice(a, b) for a, b in zip(start[s : s + 1000], [*start[s + 1 : s + 1000], start[s + 1000] if s + 1000 < len(start) else len(code)], strict=True)]
                none = pa.nulls(len(lots), pa.binary()), pa.nulls(len(lots), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part[start[s : s + 1000]], pa.int32()), *none, pa.array([code[x].tobytes() + count[x].tobytes() for x in lots], pa.binary())], names=names)
            codes.clear()

        for batch in split_batches(batches, 0):
            w = walker.walk(batch.column(0))
            if len(often):
                mine = np.flatnonzero((w.ids >= 0) & often[w.ids])
                base, at = w.ids[mine] * 2 * k, w.at[mine]
                codes += [base + w.cls[at - 1], base + k + w.cls[at + 1]]
                held += 2 * len(at)
            at = w.at[w.miss]
            code = w.cls[at - 1] * k + w.cls[at + 1]
            part = np.fromiter((xxhash.xxh32_intdigest(x) for x in w.tail.to_pylist()), np.int64, len(at)) % PARTS
            for s in range(0, len(at), ROWS):
                c = pa.array(code[s : s + ROWS], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part[s : s + ROWS], pa.int32()), w.tail.slice(s, ROWS), c, pa.nulls(len(c), pa.binary())], names=names)
            if held >= 10 * FLUSH:
                yield from known()
                held = 0
        if codes:
            yield from known()

    return arrow_map(docs.select(text), run, "part int, word binary, code long, packed binary")


def gains(start: np.ndarray, code: np.ndarray, n: np.ndarray, stats: np.ndarray, classes: int) -> np.ndarray:
    """How much the likelihood of the class bigrams `stats` gains if a word joins each of the first `classes`: words x classes.

    The rows of a word begin at `start`; a row has a code of `contexts` and its count. Counts of the word beside itself are taken
    for counts beside its old class.
    """
    k = len(stats)
    left = code < k
    beside = np.concatenate([stats[:, :classes], stats[:classes].T])  # of each code
    each = np.empty((len(code), classes))
    for count in range(1, SMALL):  # most counts: from a table
        mine = np.flatnonzero(n == count)
        if len(mine):
            each[mine] = (xlogx(beside + count) - xlogx(beside))[code[mine]]
    mine = np.flatnonzero(n >= SMALL)
    held = beside[code[mine]]
    each[mine] = xlogx(held + n[mine, None]) - xlogx(held)
    whole = np.add.reduceat(np.where(left, n, 0), start).astype(np.float64)[:, None]
    rows, cols = stats.sum(1)[:classes], stats.sum(0)[:classes]
    return np.add.reduceat(each, start, axis=0) - (xlogx(rows + whole) - xlogx(rows)) - (xlogx(cols + whole) - xlogx(cols))


def place(found: DataFrame, words: list[bytes], stats: np.ndarray, classes: int) -> DataFrame:
    """(known boolean, word, form, n, cls) for each word of `contexts`: the class of largest gain, ties to the smaller; null if it
    occurs once. Known words' counts are summed as they come; the others come sorted, and no more than a batch of them is held."""
    import pyarrow as pa

    k, shared = len(stats), found.sparkSession.sparkContext.broadcast((words, stats))

    def run(batches):
        (words, stats), rest = shared.value, None
        sums, new, held = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def summed():
            code, n = (np.concatenate(x) for x in zip(sums, *new, strict=True))
            code, where = np.unique(code, return_inverse=True)
            new.clear()
            return code, np.bincount(where, weights=n).astype(np.int64) if len(code) else n

        def best(start, code, n):
            """Class and count of each word, with codes of one neighbour."""
            whole = np.add.reduceat(np.where(code < k, n, 0), start)
            cls = np.concatenate([gains(start[a : a + 4000] - start[a], *(x[start[a] : start[a + 4000] if a + 4000 < len(start) else len(code)] for x in (code, n)), stats, classes).argmax(axis=1) for a in range(0, len(start), 4000)]) if classes else np.zeros(len(start), np.int64)
            return whole, cls

        def out(known, spelt, whole, cls):
            for s in range(0, len(whole), ROWS):
                w, c = whole[s : s + ROWS], cls[s : s + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), known)), spelt.slice(s, ROWS), pa.array(forms_of(spelt.slice(s, ROWS)), pa.int32()), pa.array(w, pa.int64()), pa.array(c, pa.int32(), mask=(w < 2) | (classes == 0))], names=["known", "word", "form", "n", "cls"])

        def placed(spelt, code):
            same = spelt.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(np.diff(same)) + 1])
            # Two codes for each row: the left neighbour's, the right neighbour's.
            both = np.stack([code // k, k + code % k], axis=1).ravel()
            whole, cls = best(*collapsed(2 * first, both))
            yield from out(False, spelt.take(pa.array(first)), whole, cls)

        def collapsed(start, code):
            """Rows of equal word and code as one, with their number."""
            word = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(code))))
            pair, n = np.unique(word * 2 * k + code, return_counts=True)
            return np.searchsorted(pair, np.arange(len(start)) * 2 * k), pair % (2 * k), n

        for batch in batches:
            spelt = batch.column(1)
            nulls = spelt.null_count  # they come first
            for packed in batch.column(3).slice(0, nulls).to_pylist():
                new.append(np.frombuffer(packed, np.int64).reshape(2, -1))
                held += new[-1].shape[1]
                if held >= 5 * FLUSH:
                    sums, held = summed(), 0
            spelt, code = spelt.slice(nulls), batch.column(2).slice(nulls).to_numpy(zero_copy_only=False)
            if not len(spelt):
                continue
            if rest is not None:
                spelt, code = pa.concat_arrays([rest[0], spelt]), np.concatenate([rest[1], code])
            # The last word may go on in the next batch.
            at = np.flatnonzero(np.diff(spelt.dictionary_encode().indices.to_numpy(zero_copy_only=False)))
            cut = int(at[-1]) + 1 if len(at) else 0
            rest = spelt.slice(cut), code[cut:]
            if cut:
                yield from placed(spelt.slice(0, cut), code[:cut])
        if rest is not None:
            yield from placed(*rest)
        code, n = summed()
        if len(code):
            ids = code // (2 * k)
            start = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
            yield from out(True, pa.array([words[i] for i in ids[start].tolist()], pa.binary()), *best(start, code % (2 * k), n))

    return found.repartition("part").sortWithinPartitions("word").mapInArrow(run, "known boolean, word binary, form int, n long, cls int")


TAIL = "word binary, own int, second binary, own2 int, before int, after int, n long"


def with_classes(rows: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """(`keys`, before, after, cls, seen, n): the rows of TAIL with a word, with classes and training counts.

    cls and seen are those of the word; two words side by side have theirs as before and after, and cls -1. Words that `placed`
    has no class for have that of their form. No key is hot: a frequent word is a known one, unless new texts are full of it.
    """
    listed = placed.where("not known").select("word", F.col("n").alias("seen"), F.col("cls").alias("found"))
    single = rows.where("word is not null and second is null").join(listed, "word", "left")
    single = single.select(*keys, "before", "after", F.coalesce("found", "own").alias("cls"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), "n")
    second = listed.select(F.col("word").alias("second"), F.col("found").alias("found2"))
    double = rows.where("second is not null").join(listed, "word", "left").join(second, "second", "left")
    double = double.select(*keys, F.coalesce("found", "own").alias("before"), F.coalesce("found2", "own2").alias("after"), F.lit(-1).alias("cls"), F.lit(0).cast("long").alias("seen"), "n")
    return single.unionByName(double)


def class_bigrams(docs: DataFrame, walker: Walker, placed: DataFrame, k: int, text: str = "text") -> np.ndarray:
    """Counts [previous class, next class] over all bigrams of `docs`; words that `walker` doesn't know have their class in `placed`."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(walker)
    names = ["word", "own", "second", "own2", "before", "after", "n"]

    def run(batches):
        total = np.zeros((k + 1) ** 2, np.int64)  # what isn't known counts in the first row and column
        for batch in split_batches(batches, 0):
            w = shared.value.walk(batch.column(0))
            c = w.cls + 1
            total += np.bincount(c[:-1] * (k + 1) + c[1:], minlength=len(total))
            rows = pa.RecordBatch.from_arrays(w.tail_rows()[1], names=names)
            for s in range(0, rows.num_rows, ROWS):
                yield rows.slice(s, ROWS)
        total = total.reshape(k + 1, k + 1)[1:, 1:].ravel()
        cells = np.flatnonzero(total)
        none, whole = pa.nulls(len(cells), pa.binary()), pa.array(np.full(len(cells), -1), pa.int32())
        yield pa.RecordBatch.from_arrays([none, whole, none, whole, pa.array(cells // k, pa.int32()), pa.array(cells % k, pa.int32()), pa.array(total[cells], pa.int64())], names=names)

    rows = materialize_table(arrow_map(docs.select(text), run, TAIL))
    met = with_classes(rows, placed, [])
    beside = F.when(F.col("cls") < 0, F.array(F.struct("before", "after"))).otherwise(F.array(F.struct("before", F.col("cls").alias("after")), F.struct(F.col("cls").alias("before"), "after")))
    met = met.select("n", F.explode(beside).alias("c")).select("c.before", "c.after", "n").where("before >= 0 and after >= 0")
    got = rows.where("word is null").select("before", "after", "n").unionByName(met).groupBy("before", "after").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((k, k))
    matrix[got["before"].to_numpy(), got["after"].to_numpy()] = got["n"].to_numpy()
    remove_table(rows)
    return matrix


class BrownModel(Walker):
    """What scoring needs: the known words with their counts and classes, class sizes and transitions, totals.

    A class emits its training words; a form's class also one unseen word, so that all chances sum to one. Classes without words
    are never entered.
    """

    def __init__(self, words: list[bytes], n: np.ndarray, cls: np.ndarray, forms: list[int], end: int, bigrams: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> None:
        super().__init__(words, cls, end, forms)
        live = kinds > 0
        live[end] = True
        spare = np.zeros(len(kinds))
        spare[forms] = 1
        live[forms] = True
        with np.errstate(divide="ignore"):
            self.step = np.log10((bigrams + SMOOTH * live) / (bigrams.sum(1, keepdims=True) + SMOOTH * live.sum()))
            self.width = np.log10(np.where(live, sizes + SMOOTH * (kinds + spare), 1.0))  # of each class, what emissions are divided by
        self.ends, self.total, self.distinct = int(sizes[end]), int(sizes.sum()), int(kinds.sum())
        if not self.ends:  # nothing learnt: an end is the only thing that its class emits
            self.width[end] = np.log10(SMOOTH)
        # By previous and next class, each one up: the step and the next class's width, as far as they are known.
        self.known_step = np.pad(self.step - self.width, ((1, 0), (1, 0)))
        self.known_step[0, 1:] = -self.width
        self.known_step = self.known_step.ravel()
        self.all = float(np.log10(self.total + SMOOTH * (self.distinct + 1)))
        self.log_n = np.log10(n + SMOOTH)


def train(docs: DataFrame, text: str = "text", known: int = KNOWN_WORDS, clustered: int = CLUSTERED_WORDS, classes: int | None = None) -> tuple[BrownModel, DataFrame]:
    """The model of `docs`, and a table (known, word, form, n, cls) of the words beyond the clustered ones.

    Null texts are empty. Any table does: of an empty one, and of one without repeated words, every word has the class of its form.
    Words of equal count are ordered by their bytes, ties between classes go to the smaller number.
    """
    counts = materialize_table(word_counts(docs, text))
    sums = counts.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    distinct = sum(r.v for r in sums if r.form >= 0)
    words, n = frequent_words(counts, known)
    chosen = min(clustered, int((n >= 2).sum()))
    bigrams = symbol_bigrams(docs, words[:chosen], text)
    of = exchange(bigrams, chosen, classes or max(LEAST_CLASSES, round(distinct**CLASS_POWER)))
    k = int(of.max()) + 1
    member = np.zeros((len(of), k))
    member[np.arange(len(of)), of] = 1
    forms, end = of[chosen : chosen + FORMS].tolist(), int(of[-1])
    placed = materialize_table(place(contexts(docs, words, n, chosen, of, text), words, member.T @ bigrams.astype(np.float64) @ member, k - FORMS - 1))
    # The known words' classes come to the driver.
    cls = np.array([of[i] if i < chosen else forms[form(w)] for i, w in enumerate(words)], np.int64)
    index = {w: i for i, w in enumerate(words)}
    got = placed.where("known and cls is not null").select("word", "cls").toArrow()
    cls[[index[w] for w in got["word"].to_pylist()]] = got["cls"].to_numpy()
    # Class sizes: by form at first; placed and clustered words leave the class of their form.
    sizes, kinds = np.zeros(k), np.zeros(k)
    for r in sums:
        at = end if r.form < 0 else forms[r.form]
        sizes[at], kinds[at] = r.n, r.v
    moves = [(r.form, r.cls, r.n, r.v) for r in placed.where("cls is not null").groupBy("form", "cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()]
    for f, c, m, v in moves + [(form(words[i]), of[i], n[i], 1) for i in range(chosen)]:
        sizes[[forms[f], c]] += [-m, m]
        kinds[[forms[f], c]] += [-v, v]
    remove_table(counts)
    steps = class_bigrams(docs, Walker(words, cls, end, forms), placed, k, text)
    return BrownModel(words, n, cls, forms, end, steps, sizes, kinds), placed


def score(docs: DataFrame, model: BrownModel, placed: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), a row for each row of `docs`.

    base_score: log10 probability by smoothed single words; score: by the class model. Null texts are empty and have one token,
    the end. Rows with null or repeated ids keep their own results; rows alike in id and text have the same. Other columns of
    `docs` are not looked at; an empty table gives an empty one.
    """
    import pyarrow as pa
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast(model)
    inputs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    id_type = inputs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, mark long, whole int, n_tokens long, n_known long, base double, cls double, {TAIL}"
    names = ["doc_id", "mark", "whole", "n_tokens", "n_known", "base", "cls", "word", "own", "second", "own2", "before", "after", "n"]

    def run(batches):
        m = shared.value
        width = len(m.step) + 1
        for batch in split_batches(batches, 1):
            texts = utf8(batch.column(1))
            w, rows = m.walk(batch.column(1)), len(texts)
            hit = np.flatnonzero(w.ids >= 0)
            logs = np.bincount(w.text[hit], m.log_n[w.ids[hit]], rows) + np.log10(m.ends + SMOOTH)
            # A step belongs to the text of the place that it leads to.
            text = np.repeat(np.arange(rows), w.size + 1)
            c = w.cls + 1
            steps = m.known_step[c[:-1] * width + c[1:]]
            n = w.size + 1
            marks = np.array([xxhash.xxh3_64_intdigest(data) - (1 << 63) for data in texts], np.int64)
            at, tail = w.tail_rows()
            more = len(at)
            full = lambda x, kind: pa.array(np.concatenate([x, np.zeros(more, x.dtype)]), kind)
            own = [full(np.ones(rows, np.int32), pa.int32()), full(n, pa.int64()), full(np.bincount(w.text[hit], minlength=rows) + (m.ends > 0), pa.int64()), full(logs - n * m.all, pa.float64()), full(logs + np.bincount(text, steps, rows), pa.float64())]
            blank = [pa.nulls(rows, pa.binary()), pa.array(np.full(rows, -1), pa.int32())]
            tail = [pa.concat_arrays([blank[0] if pa.types.is_binary(x.type) else blank[1] if pa.types.is_int32(x.type) else pa.array(np.zeros(rows, np.int64)), x]) for x in tail]
            order = np.concatenate([np.arange(rows), at])
            whole = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order)), pa.array(marks[order]), *own, *tail], names=names)
            for s in range(0, whole.num_rows, ROWS):
                yield whole.slice(s, ROWS)

    def rate(batches):
        m = shared.value
        for batch in batches:
            before, after, cls, seen, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7))
            step = lambda a, b: np.where((a >= 0) & (b >= 0), m.step[a, b], 0.0)
            logs = np.where(cls >= 0, np.log10(seen + SMOOTH), 0.0)
            by_class = np.where(cls >= 0, logs - m.width[cls] + step(before, cls) + step(cls, after), step(before, after))
            arrays = [batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in ((np.where((cls >= 0) & (seen > 0), n, 0), pa.int64()), (n * logs, pa.float64()), (n * by_class, pa.float64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "n_known", "base", "cls"])

    rows = materialize_table(arrow_map(inputs, run, schema))
    keys = ["doc_id", "mark"]
    tail = with_classes(rows, placed, keys).mapInArrow(rate, f"doc_id {id_type}, mark long, n_known long, base double, cls double")
    tail = tail.select(*keys, F.lit(0).alias("whole"), F.lit(0).cast("long").alias("n_tokens"), "n_known", "base", "cls")
    summed = (
        rows.where("word is null")
        .select(*tail.columns)
        .unionByName(tail)
        .groupBy(*keys)
        .agg(F.sum("whole").alias("whole"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("cls").alias("score"))
    )
    each = [(F.col(c) / F.col("whole")).cast("long").alias(c) for c in ("n_tokens", "n_known")] + [(F.col(c) / F.col("whole")).alias(c) for c in ("base_score", "score")]
    return summed.select("doc_id", *each, F.explode(F.array_repeat(F.lit(0), F.col("whole").cast("int"))).alias("__copy")).drop("__copy")


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; edge cases as in `train` and `score`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 1)
    model, placed = train(docs.where(~out))
    scored = score(docs, model, placed)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
