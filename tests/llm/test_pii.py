import hashlib
import random
import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scene_analytics.llm import pii


sys.set_int_max_str_digits(0)


def brute(text):
    """The base spans by the patterns themselves."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


SCAN = pii.Scanner().scan


def base(text):
    return [s for s in SCAN(text) if s[0] in pii.BASE]


@pytest.mark.parametrize("text", ["", "a@b.c", "a@b.c@d.e", "a@@b.c x@y", "x@y.z.", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.2.3.4 00000000000001.2.3.4 00000000000000000.0.0.00000000000", "4111 1111 1111 1111", "4111-1111-1111-11111", "+1 (988) 555-2485", "++44 20 7946 0958+1", "+1" + " 2" * 20, "é@é.com İ@x.yz", "12 34.5.6.7-8.9.1.2", "a" * 9000 + "@b.c", "1" * 9000 + ".1.1.1", "٣٤@x.yz ²@x.yz"])
def test_base_cases(text):
    assert base(text) == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@+-_ 0123456789()é%K", max_size=50))
def test_base_any(text):
    assert base(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "255", "256", ".", "@", "+", " ", "-", "x", "4111111111111111", "a@b.cd", "\n", "(", ")", "é"]), max_size=30).map("".join))
def test_base_pieces(text):
    assert base(text) == brute(text)


def test_added_kinds():
    text = "See https://a.example/x?y=1, write mailto:me@a.example. IBAN: GB82 WEST 1234 5698 7654 32. Account no: 12345678, ask @some_one."
    got = {k: [text[s:e] for kind, s, e in SCAN(text) if kind == k] for k in pii.KINDS}
    assert got["url"] == ["https://a.example/x?y=1", "mailto:me@a.example"] and got["email"] == ["me@a.example"]
    assert got["account"] == ["GB82 WEST 1234 5698 7654 32", "12345678"] and got["handle"] == ["@some_one"]


def test_query(spark, tmp_path):
    rng = random.Random(1)
    parts = ["x@y.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", "text", "é\U0001f600", "\n", "."]
    texts = [None, "", "x@y.co " * 9000] + [" ".join(rng.choices(parts, k=12)) for _ in range(60)]
    rows = [(i if i != 5 else None, t, "s") for i, t in enumerate(texts + texts[:4])]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in pii.op3_pii(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t, _ in rows:
        spans = brute(t or "")
        n = [sum(s[0] == k for s in spans) for k in pii.BASE]
        want.append((d, *n, hashlib.sha256(pii.joined(spans).encode()).hexdigest(), pii.joined(SCAN(t or ""))))
    assert got == sorted(want, key=str)
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
