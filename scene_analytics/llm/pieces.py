"""SentencePiece encoding and decoding that keeps the place of every piece in the original bytes.

The text is normalised by taking, at each place, the longest prefix found in the model's compiled character map; every byte of
the normalised text keeps the original offset it came from. Byte-pair merging then runs on chunks between which no piece of the
vocabulary can reach, each different chunk of a batch once. Each piece is projected to its original byte span.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, carried, split_batches, table, utf8, without

MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()  # what stands for a space inside pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks of up to so many characters are merged together, in tables of these widths and so many rows; longer ones by a heap.
WIDTHS, ROWS = (8, 12, 20, 48), 4096
NEVER = np.iinfo(np.int32).max


# --- the model file: protocol buffers, read by their public wire format -------------------------------------------------------


def _fields(data: bytes):
    at, end = 0, len(data)

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"unexpected wire type {kind}")
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: tuple[bytes, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    charsmap: bytes
    dummy_prefix: bool
    strip_spaces: bool
    escape_spaces: bool
    unk_surface: str

    @classmethod
    def read(cls, data: bytes) -> Model:
        pieces, scores, kinds = [], [], []
        norm = {"charsmap": b"", "dummy_prefix": True, "strip_spaces": True, "escape_spaces": True}
        unk, algorithm, suffix = " ⁇ ", 1, 0
        for field, value in _fields(data):
            if field == 1:
                piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value))
                pieces.append(piece[1])
                scores.append(struct.unpack("<f", piece[2])[0])
                kinds.append(piece[3])
            elif field == 2:
                trainer = dict(_fields(value))
                algorithm, suffix = trainer.get(3, 1), trainer.get(24, 0)
                unk = trainer[44].decode() if 44 in trainer else unk
            elif field == 3:
                for key, v in _fields(value):
                    if key == 2:
                        norm["charsmap"] = v
                    elif key in (3, 4, 5):
                        norm[{3: "dummy_prefix", 4: "strip_spaces", 5: "escape_spaces"}[key]] = bool(v)
        if algorithm != 2 or suffix:
            raise ValueError("only byte-pair models with leading space marks are supported")
        return cls(tuple(pieces), tuple(scores), tuple(kinds), norm["charsmap"], norm["dummy_prefix"], norm["strip_spaces"], norm["escape_spaces"], unk)


# --- normalisation --------------------------------------------------------------------------------------------------------------


class CharacterMap:
    """The compiled map: a double-array trie over source bytes whose values point into a block of NUL-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.block = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """Bytes of the longest key that starts at `at`, and its replacement; (0, None) if no key fits."""
        units, best, value = self.units, 0, 0
        if not units:
            return 0, None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            c = data[i]
            if not c:
                break
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                best, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return (best, self.block[value : self.block.index(b"\0", value)]) if best else (0, None)


class Normaliser:
    """Text bytes to normalised bytes and, for each of these and the end, the original byte offset they stand for."""

    def __init__(self, model: Model) -> None:
        self.model, self.map = model, CharacterMap(model.charsmap)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.model.strip_spaces:
            return self._identity(data)
        return self._mapped(data)

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """No key: every prefix found is a single character that stands for itself."""
        mark = MARK if self.model.escape_spaces else b" "
        out = (mark if self.model.dummy_prefix else b"") + data.replace(b" ", mark)
        width = np.ones(len(data), np.int64)
        if self.model.escape_spaces:
            width[np.frombuffer(data, np.uint8) == 32] = len(MARK)
        place = np.repeat(np.arange(len(data)), width)
        head = np.zeros(len(mark) if self.model.dummy_prefix else 0, np.int64)
        return out, np.concatenate([head, place, [len(data)]])

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, place = bytearray(), []
        mark = MARK if self.model.escape_spaces else b" "
        at, end, was_space = 0, len(data), self.model.strip_spaces

        def longest(at: int) -> tuple[int, bytes]:
            n, to = self.map.longest(data, at)
            if n:
                return n, to
            n = min(4 if data[at] >= 0xF0 else 3 if data[at] >= 0xE0 else 2 if data[at] >= 0xC0 else 1, end - at)
            return n, data[at : at + n]

        if self.model.strip_spaces:
            while at < end and (step := longest(at))[1] == b" ":
                at += step[0]
        if at == end:
            return b"", np.array([end])
        if self.model.dummy_prefix:
            out += mark
            place += [at] * len(mark)
        while at < end:
            n, to = longest(at)
            if was_space:
                to = to.lstrip(b" ")
            if to:
                was_space = self.model.strip_spaces and to.endswith(b" ")
                to = to.replace(b" ", mark)
                out += to
                place += [at] * len(to)
            at += n
        if self.model.strip_spaces:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = place[len(out)]
                del place[len(out) :]
        return bytes(out), np.array([*place, end])


# --- encoding and decoding --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Encoding:
    ids: list[int]
    #: Original byte offsets, [start, end) for each id; ids added at the end have empty spans there.
    starts: np.ndarray
    ends: np.ndarray


class _Together:
    """Merges many short chunks at once: a row of symbols for each, every step merges each row's best pair, leftmost if equal."""

    def __init__(self, enc: PieceEncoder) -> None:
        identity, order = enc.identity, enc.order
        self.symbols = dict(identity)
        for p in identity:  # single characters of pieces are symbols, too, be they pieces or not
            for c in p:
                self.symbols.setdefault(c, len(enc.model.pieces) + len(self.symbols))
        self.known = len(enc.model.pieces)
        n = self.base = max(self.symbols.values(), default=0) + 1
        self.of = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.of[ord(c)] = i
        self.size = np.zeros(n, np.uint32)
        for p, i in self.symbols.items():
            self.size[i] = len(p.encode())
        ranked = {x: r for r, x in enumerate(sorted(set(order.values())))}
        pairs = [(self.symbols[p[:k]] * n + self.symbols[p[k:]], i, ranked[order[p]]) for p, i in identity.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols]
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.key, self.to, self.rank = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        for key, to, rank in pairs:
            at = self._slot(key)
            while self.key[at] >= 0:
                at = (at + 1) % size
            self.key[at], self.to[at], self.rank[at] = key, to, rank

    def _slot(self, key):
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each pair's merge; NEVER where there is none."""
        key = np.where((a < 0) | (b < 0), -2, a.astype(np.int64) * self.base + b)
        rank, to = np.full(len(key), NEVER, np.int32), np.full(len(key), -1, np.int32)
        todo = np.flatnonzero(key >= 0)
        at = self._slot(key[todo])
        while len(todo):
            held = self.key[at]
            hit = held == key[todo]
            rank[todo[hit]], to[todo[hit]] = self.rank[at[hit]], self.to[at[hit]]
            on = ~hit & (held >= 0)
            todo, at = todo[on], (at[on] + 1) % len(self.key)
        return rank, to

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of all texts in a row, how many each text has, and whether it is settled: all its characters are in pieces."""
        m, width = len(texts), max(map(len, texts))
        length = np.fromiter(map(len, texts), np.int64, m)
        inside = np.arange(width) < length[:, None]
        s = np.full((m, width + 1), -1, np.int32)
        s[:, :-1][inside] = self.of[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        whole = ((s[:, :-1] >= 0) | ~inside).all(axis=1)
        right = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), s.shape).copy()
        left = right - 2
        rank, to = (x.reshape(m, width) for x in self._look(s[:, :-1].ravel(), s[:, 1:].ravel()))
        alive, row = inside.copy(), np.arange(m)
        while len(row):
            i = rank[row].argmin(axis=1)
            go = rank[row, i] < NEVER
            row, i = row[go], i[go]
            if not len(row):
                break
            j = right[row, i]
            s[row, i] = to[row, i]
            alive[row, j] = False
            rank[row, j] = NEVER
            k = right[row, j]
            right[row, i] = k
            inner = k <= width
            left[row[inner], k[inner]] = i[inner]
            rank[row, i], to[row, i] = self._look(s[row, i], s[row, np.minimum(k, width)])
            h = left[row, i]
            back = h >= 0
            r, h, i = row[back], h[back], i[back]
            rank[r, h], to[r, h] = self._look(s[r, h], s[r, i])
        whole &= np.where(alive, s[:, :-1] < self.known, True).all(axis=1)
        ids = s[:, :-1][alive]
        return ids, self.size[ids], alive.sum(axis=1), whole


class PieceEncoder:
    """Encodes and decodes as the public library does, and knows where each piece came from."""

    def __init__(self, data: bytes) -> None:
        self.model = m = Model.read(data)
        self.normalise = Normaliser(m)
        if USER in m.kinds or UNUSED in m.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.identity = {p.decode(): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == NORMAL}
        self.order = {p: -m.scores[i] for p, i in self.identity.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == BYTE}
        self.value = {i: b for b, i in self.bytes.items()}
        self.unknown = m.kinds.index(UNKNOWN)
        self.end = m.pieces.index(b"</s>")
        #: No piece goes on from another character to a mark: chunks that start at such marks don't depend on each other.
        self.apart = not any(MARK.decode() in p.lstrip(MARK.decode()) for p in self.identity)
        self.lines_apart = not any("\n" in p for p in self.identity) and bool(self.bytes)
        self.surface = [b"" if k == CONTROL else m.unk_surface.encode() if k == UNKNOWN else bytes([self.value[i]]) if k == BYTE else p.replace(MARK, b" ") for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True))]
        self.decimal = [str(i) for i in range(len(m.pieces))]
        self.together = _Together(self)

    def _merge(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of a chunk, and how many normalised bytes each of them covers."""
        ids, sizes, identity = [], [], self.identity
        for p in self._merge_long(list(text)):
            n = len(p.encode())
            if (i := identity.get(p)) is not None:
                ids.append(i)
                sizes.append(n)
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode()]
                sizes += [1] * n
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += n
            else:
                ids.append(self.unknown)
                sizes.append(n)
        return ids, sizes

    def _merge_long(self, part: list[str | None]) -> list[str]:
        """Best pair first, the leftmost among equals, with a heap: for long chunks and those with characters in no piece."""
        get, n = self.order.get, len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def offer(a: int, b: int) -> None:
            joined = part[a] + part[b]
            if (r := get(joined)) is not None:
                heapq.heappush(heap, (r, a, b, len(joined)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if part[a] is None or part[b] is None or right[a] != b or len(part[a]) + len(part[b]) != size:
                continue
            part[a] += part[b]
            part[b] = None
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        return [p for p in part if p is not None]

    def _chunks(self, norm: bytes) -> list[bytes]:
        if not self.apart:
            return [norm]
        if self.lines_apart and b"\n" in norm:  # a line end is in no piece; its byte piece stands alone
            chunks = []
            for line in norm.split(b"\n"):
                chunks += self._words(line)
                chunks.append(b"\n")
            return chunks[:-1]
        return self._words(norm)

    def _words(self, norm: bytes) -> list[bytes]:
        # A chunk is a run of marks with what follows it. Splitting leaves an empty word between two marks of a run.
        words = norm.split(MARK)
        chunks, marks = ([words[0]] if words[0] else []), 0
        for w in words[1:]:
            marks += 1
            if w:
                chunks.append(MARK * marks + w)
                marks = 0
        return chunks + ([MARK * marks] if marks else [])

    def _merge_all(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of all chunks in some order, and where those of each chunk start and how many there are."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        start, count = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        ids, sizes, total = [], [], 0
        settled = np.zeros(len(chunks), bool)
        for lo, hi in zip((0, *WIDTHS), WIDTHS, strict=False):
            some = np.flatnonzero((length > lo) & (length <= hi))
            for at in np.split(some, range(ROWS, len(some), ROWS)):
                if not len(at):
                    continue
                i, z, n, whole = self.together([texts[k] for k in at.tolist()])
                start[at], count[at], settled[at] = total + np.cumsum(n) - n, n, whole
                ids.append(i)
                sizes.append(z)
                total += len(i)
        for k in np.flatnonzero(~settled).tolist():
            i, z = self._merge(texts[k])
            start[k], count[k] = total, len(i)
            ids.append(np.array(i, np.int32))
            sizes.append(np.array(z, np.uint32))
            total += len(i)
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.uint32), *sizes]), start, count

    def encode(self, data: bytes, add_end: bool = True) -> Encoding:
        return self.encode_all([data], add_end)[0]

    def encode_all(self, texts: list[bytes], add_end: bool = True) -> list[Encoding]:
        """Each text's encoding; the different chunks of all texts are merged once and together."""
        normal = [self.normalise(data) for data in texts]
        split = [self._chunks(norm) for norm, _ in normal]
        chunks = list(set().union(*split))
        ids, sizes, start, count = self._merge_all(chunks)
        index = dict(zip(chunks, range(len(chunks)), strict=True))
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        n = count[at]
        ends = np.cumsum(n)
        take = np.repeat(start[at] - ends + n, n) + np.arange(int(n.sum()))
        ids, sizes = ids[take], sizes[take]
        cut = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])].tolist()
        out = []
        for data, a, b, (_, place) in zip(texts, cut, cut[1:], normal, strict=False):
            edges = np.concatenate([[0], np.cumsum(sizes[a:b], dtype=np.int64)])
            starts, stops, own = place[edges[:-1]], place[edges[1:]], ids[a:b].tolist()
            if add_end:
                own.append(self.end)
                starts, stops = np.append(starts, len(data)), np.append(stops, len(data))
            out.append(Encoding(own, starts, stops))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: marks are spaces, the first piece loses the added one, byte pieces are joined to characters."""
        m, out, first = self.model, [], True
        pieces, kinds, value = m.pieces, m.kinds, self.value
        surface = self.surface
        joined = b"".join([surface[i] for i in ids])
        try:  # whole characters all through: byte pieces then make whole characters among themselves, too
            text = joined.decode()
        except UnicodeDecodeError:
            pass
        else:
            head = next((i for i in ids if kinds[i] != CONTROL), None)
            return text[1:] if head is not None and kinds[head] == NORMAL and (m.dummy_prefix or m.strip_spaces) and pieces[head].startswith(MARK) else text
        run = bytearray()
        for i in [*ids, None]:
            if i is not None and i in value:
                run.append(value[i])
                continue
            if run:
                out.append(bytes(run).decode("utf-8", "strict") if _valid(run) else _lenient(bytes(run)))
                run.clear()
                first = False
            if i is None or kinds[i] == CONTROL:
                continue
            if i == self.unknown:
                out.append(m.unk_surface)
            else:
                p = pieces[i]
                if first and (m.dummy_prefix or m.strip_spaces) and p.startswith(MARK):
                    p = p[len(MARK) :]
                    first = False
                    out.append(p.replace(MARK, b" ").decode())
                    continue
                out.append(p.replace(MARK, b" ").decode())
            first = False
        return "".join(out)


def _valid(run: bytearray) -> bool:
    try:
        run.decode("utf-8", "strict")
    except UnicodeDecodeError:
        return False
    return True


def _lenient(run: bytes) -> str:
    """Each byte that starts no whole character becomes one replacement character."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode("utf-8", "strict"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each model file and worker."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = PieceEncoder(f.read())
    return _ENCODERS[path]


def model_path(name: str = MODEL) -> str:
    """The file of an installed public tokenizer; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, model: str | None = None, outputs: tuple[str, ...] = ("ids", "starts", "ends", "decoded"), text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of `docs` (columns `keep`, all by default) with the asked `outputs` of encoding `text` with an end id.

    ids, starts, ends: lists, one entry for each piece, offsets in UTF-8 bytes of the original text; decoded: the text that the
    ids decode to; n_tokens; ids_sha256: of the decimal ids joined by one space; decoded_sha256; spans_sha256: of start:end pairs
    joined by commas. A null text is an empty one and has the end id only. Columns of `docs` that have the name of an output are
    replaced. Rows are independent: order, repeats and empty tables need no care. Texts stay whole; long ones are cut nowhere.
    `model` is a path on each machine; by default the installed public model.
    """
    import pyarrow as pa

    kinds = {"ids": "array<int>", "starts": "array<long>", "ends": "array<long>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "spans_sha256": "string"}
    arrow = {"ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "n_tokens": pa.int64()}
    keep = without(keep if keep is not None else docs.columns, outputs)
    inputs, at = carried(docs, keep, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields[: len(keep)]] + [f"`{c}` {kinds[c]}" for c in outputs])

    def run(batches):
        enc = encoder(model or model_path())
        for batch in split_batches(batches, at, 2 << 20):
            got: dict[str, list] = {c: [] for c in outputs}
            for e in enc.encode_all(utf8(batch.column(at))):
                made = {"ids": e.ids, "starts": e.starts, "ends": e.ends, "n_tokens": len(e.ids)}
                if "decoded" in got or "decoded_sha256" in got:
                    made["decoded"] = enc.decode(e.ids)
                if "decoded_sha256" in got:
                    made["decoded_sha256"] = hashlib.sha256(made["decoded"].encode()).hexdigest()
                if "ids_sha256" in got:
                    made["ids_sha256"] = hashlib.sha256(" ".join([enc.decimal[i] for i in e.ids]).encode()).hexdigest()
                if "spans_sha256" in got:
                    made["spans_sha256"] = hashlib.sha256(np.stack([e.starts, e.ends]).astype("<i8").tobytes()).hexdigest()
                for c, values in got.items():
                    values.append(made[c])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(got[c], arrow.get(c, pa.string())) for c in outputs]], names=[*keep, *outputs])

    return arrow_map(inputs, run, schema)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many ids, digests of the ids, of the text they decode to and of the byte spans of the pieces."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"), keep=("doc_id",))
