"""Personal data: regular expressions propose spans, checksums confirm them, context words nearby adjust a score.

Base kinds (email, ip, card, phone) are decided by pattern and checksum alone, and their scores tell how likely each is. The
method adds kinds of its own, which also need a score of LEAST: `iban` (mod 97), unless words nearby say that it is some
other number, and `ssn`, only beside a word that says so.

Defined results: a null text counts as empty and has no spans; every row gives one row, rows with the same id too; an
empty table gives an empty one; further columns are ignored. Patterns are read in time linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is read from its start: what fails there fails at each later digit of the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Context words and what one of them within WINDOW code points adds to a span's score.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Words that speak against a kind, and take MALUS off the score.
AGAINST = {
    "email": ("example", "placeholder"),
    "ip": ("version", "release", "build"),
    "card": ("order", "invoice", "tracking", "isbn"),
    "phone": ("isbn", "order", "serial"),
    "iban": ("order", "tracking", "serial", "part number"),
    "ssn": ("order", "invoice", "part number"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6, "ssn": 0.3}
WINDOW, BONUS, MALUS, LEAST = 40, 0.2, 0.3, 0.5
_words = lambda w: re.compile(r"\b(?:" + "|".join(w) + r")", re.I)
_CONTEXT, _AGAINST = ({k: _words(w) for k, w in table.items()} for table in (CONTEXT, AGAINST))


def _near(words: re.Pattern, text: str, a: int, b: int) -> bool:
    return bool(words.search(text, max(0, a - WINDOW), a) or words.search(text, b, b + WINDOW))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @: the part before it is the run of local characters that
    ends there, not earlier than the end of the last address."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        floor = at + 1
        if start < at and (m := _HOST.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    return out


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then by kind as in KINDS."""
    found: list[tuple[str, int, int]] = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    found += [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0])]
    if "-" in text:
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out = []
    for kind, a, b in found:
        score = round(min(1.0, PRIOR[kind] + BONUS * _near(_CONTEXT[kind], text, a, b)) - MALUS * _near(_AGAINST[kind], text, a, b), 3)
        if kind in BASE or score >= LEAST:
            out.append((kind, a, b, score))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans array<struct<kind,start,end,score>> in code points, ends exclusive."""
    arrow_rows(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, _SPAN)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def span_digest(docs: DataFrame, base: tuple[str, ...]) -> list:
    """Columns base_sha256 and spans of a column `spans`, for the queries."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return [F.sha2(joined(F.filter("spans", lambda s: s.kind.isin(*base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")]


def scores() -> Column:
    """The scores of `spans`, in their order."""
    return F.array_join(F.transform("spans", lambda s: s.score.cast("string")), ",")


def confident() -> Column:
    """How many of `spans` have a score of LEAST or more."""
    return F.size(F.filter("spans", lambda s: s.score >= LEAST)).cast("long")


def counts(base: tuple[str, ...]) -> list:
    of = lambda k: F.filter("spans", lambda s: s.kind == k)
    return [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
