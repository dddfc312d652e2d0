import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scene_analytics.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    path = pieces.model_path()
    return pieces.encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)


CASES = ["", " ", "  ", "a", " a  b▁c ", "\n\n x\t\r", "éêñ 中文 \U0001f600!", "</s> <s> <unk> <0x41>", "x" * 5000, "ab " * 3000, "▁▁▁", "\x00\x01", "   lead", "trail   ", "a\n b", "́́", "� ￾"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_and_decoding_as_the_library(both, text):
    ours, library = both
    e = ours.encode(text.encode())
    want = library.encode(text, add_eos=True)
    assert e.ids == want
    assert ours.decode(e.ids) == library.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    ours, library = both
    e = ours.encode(text.encode())
    assert e.ids == library.encode(text, add_eos=True)
    assert ours.decode(e.ids) == library.decode(e.ids)
    assert e.starts[0] == 0 and e.ends[-1] == len(text.encode())
    assert (e.starts[1:] == e.ends[:-1]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=12), st.lists(st.integers(0, 258), max_size=6))
def test_decoding_any_ids(both, a, b):
    ours, library = both
    ids = a + b + a[:2]
    assert ours.decode(ids) == library.decode(ids)


def test_spans_cover_the_piece(both):
    ours, _ = both
    data = "Hé the  end\n of".encode()
    e = ours.encode(data)
    for i, s, t in zip(e.ids[:-1], e.starts, e.ends, strict=False):
        piece = ours.model.pieces[i].replace(pieces.MARK, b" ")
        assert i < 259 or data[s:t] == piece or (s == 0 and data[s:t] == piece[1:])


def _trie(keys: dict[bytes, bytes]) -> bytes:
    """A compiled character map with these keys, for tests: units laid out far apart."""
    import struct

    block, value = b"", {}
    for k, v in keys.items():
        value[k] = len(block)
        block += v + b"\0"
    prefixes = sorted({k[:i] for k in keys for i in range(len(k) + 1)}, key=len)
    base = {p: 256 * (n + 1) for n, p in enumerate(prefixes)}
    units = [0] * (256 * (len(prefixes) + 2))
    at = {b"": 0}
    for p in prefixes:
        me = at[p]
        offset = base[p] ^ me
        label = p[-1] if p else 0
        assert offset < 1 << 21
        units[me] = offset << 10 | (1 << 8 if p in keys else 0) | label
        if p in keys:
            units[base[p]] = 1 << 31 | value[p]
        for q in prefixes:
            if len(q) == len(p) + 1 and q.startswith(p):
                at[q] = base[p] ^ q[-1]
    raw = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(raw)) + raw + block


def test_longest_prefix_and_alignment():
    keys = {b"ab": b"X", b"abc": b"YY", "é".encode(): b"e", b"\t": b" "}
    m = pieces.Model((), (), (), _trie(keys), True, True, True, "")
    norm, place = pieces.Normaliser(m)("\t abcabé\t\tz ".encode())
    assert norm == pieces.MARK + b"YYXe" + pieces.MARK + b"z"
    assert place.tolist() == [2, 2, 2, 2, 2, 5, 7, 9, 9, 9, 11, 12]


def test_query(spark, tmp_path, both):
    _, library = both
    rng = random.Random(1)
    texts = [None, "", "same", "same", "long " * 40_000] + ["".join(rng.choice("ab \né中") for _ in range(50)) for _ in range(40)]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pieces.op6_pieces(spark, str(tmp_path)).collect()}
    for i, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode_documents(empty).count() == 0
    row = pieces.encode_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert row.text == "a b" and row.decoded == "a b" and np.array(row.ends)[-1] == 3
