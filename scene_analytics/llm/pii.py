"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, digits, plus signs and identifier cues. Deterministic local parsers
expand each anchor to both sides and validate the boundaries of e-mail addresses, network addresses, accounts and numbers.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, split_batches, table, without

#: Kinds in the order in which they are listed; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "handle")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "passport", "ssn", "kontonummer", "konto-nr", "cuenta", "compte", "tax id", "vat no")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\x00-\x20\x7f\"'<>\\^`{|}]+")
HANDLE = re.compile(r"[A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@])(?!\.[A-Za-z0-9])")
ACCOUNT = re.compile(r"[\x20:=#.]{1,3}(?:(?:no|nr|number|id)[\x20:=#.]{1,3})?([A-Z]{0,2}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(code: str) -> bool:
    moved = code[4:] + code[:4]
    return bool(IBAN.match(code)) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for mark in ("@", "+", *"0123456789"):
        a.add_word(mark, (mark if mark in "@+" else "digit", 1))
    for words, kind in ((SCHEMES, "scheme"), (CUES, "cue")):
        for w in words:
            for spelt in (w, w.upper(), w.capitalize(), w.title()):
                a.add_word(spelt, (kind, len(w)))
    a.make_automaton()
    return a


class Scanner:
    """Finds personal data in one text; offsets are code points, ends exclusive."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def _email(self, text: str, at: int, after: int) -> tuple[int, int] | None:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        if start == at:
            return None
        m = DOMAIN.match(text, at + 1)
        return (start, m.end()) if m else None

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """Spans (kind, start, end), by kind as listed and then by start.

        A base kind's spans are what its pattern finds from the left without overlaps, tried only where an anchor is; each later
        try starts where the last match of its kind ended, kept or not.
        """
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        after = dict.fromkeys(KINDS, 0)
        for last, (kind, n) in self.anchors.iter(text):
            at = last - n + 1
            if kind == "digit":
                if at >= after["ip"] and (at == after["ip"] or not "0" <= text[at - 1] <= "9"):
                    m = QUAD.match(text, at)
                    if m:
                        after["ip"] = m.end()
                        if all(len(p) < 9 and int(p) <= 255 or not p.strip("0") or int(p.lstrip("0")[:4]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split(".")):
                            found["ip"].append(m.span())
                if at >= after["card"]:
                    m = CARD.match(text, at)
                    if m:
                        after["card"] = m.end()
                        digits = re.sub("[^0-9]", "", m[0]) if len(m[0]) <= 40 else ""
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(m.span())
            elif kind == "+":
                if at >= after["phone"]:
                    m = PHONE.match(text, at)
                    if m:
                        after["phone"] = m.end()
                        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                            found["phone"].append(m.span())
            elif kind == "@":
                span = self._email(text, at, after["email"])
                if span:
                    after["email"] = span[1]
                    found["email"].append(span)
                elif at >= after["email"] and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in LOCAL)):
                    m = HANDLE.match(text, at + 1)
                    if m:
                        found["handle"].append((at, m.end()))
            elif kind == "scheme":
                if at >= after["url"] and not (at and text[at - 1].isalnum()):
                    m = URL.match(text, at + n)
                    if m:
                        end = at + n + len(m[0].rstrip(".,;:!?)]"))
                        if end > at + n:
                            found["url"].append((at, end))
                            after["url"] = end
            elif at >= after["account"] and not (at and text[at - 1].isalnum()):
                m = ACCOUNT.match(text, at + n)
                if m:
                    code = re.sub("[ -]", "", m[1])
                    if sum(c.isdigit() for c in code) >= 6 and (not code[:2].isalpha() or iban(code)):
                        found["account"].append(m.span(1))
                        after["account"] = m.end(1)
        return [(k, *s) for k in KINDS for s in found[k]]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SCANNER: list[Scanner] = []


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of `docs` and spans: a list of (kind, start, end) in code points, end exclusive, for every row.

    By their formats a handle has 2 to 30 characters and an account code 6 to 34; longer runs are neither.

    A null text is an empty one and has no span. Texts are scanned whole. Rows are independent; repeats stay, an empty table gives
    an empty one; a kept column named spans is replaced. URL parts that hold an address or number are reported for both kinds.
    """
    import pyarrow as pa

    keep = without(keep, ["spans"])
    inputs, at = carried(docs, keep, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields[: len(keep)]] + ["spans array<struct<kind:string,start:long,end:long>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        if not _SCANNER:
            _SCANNER.append(Scanner())
        scan = _SCANNER[0].scan
        for batch in split_batches(batches, at):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x or "")] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(spans, kind)], names=[*keep, "spans"])

    return arrow_map(inputs, run, schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; edge cases as in `find_personal_data`."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def digest(spans) -> str:
    return hashlib.sha256(joined(s for s in spans if s[0] in BASE).encode()).hexdigest()
