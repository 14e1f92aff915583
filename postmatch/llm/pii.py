"""Personal data: patterns propose spans, checksums confirm, words nearby weigh in."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from postmatch.llm.common import map_batches, texts, thin

#: The four base kinds, then those that checksums and context add.
KINDS = ("email", "ip", "card", "phone", "iban", "routing", "ssn")
BASE = KINDS[:4]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only, and never given back: a match cannot
# begin inside one, and looking there would take time in the square of its length.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
ROUTING = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])")
SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")

#: Score of a span without and with a confirming word near it.
SCORES = {"email": (0.9, 1.0), "ip": (0.7, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.9),
          "iban": (0.8, 1.0), "routing": (0.2, 0.8), "ssn": (0.4, 0.9)}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "routing": ("routing", "aba", "bank", "wire"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("example", "sample", "order", "isbn", "part", "version")
NEAR = 48
THRESHOLD = 0.5
WORD = re.compile(r"[a-z]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in even)) % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def routing_sum(d: str) -> bool:
    n = list(map(int, d))
    return (3 * (n[0] + n[3] + n[6]) + 7 * (n[1] + n[4] + n[7]) + n[2] + n[5] + n[8]) % 10 == 0


def emails(text: str):
    """Every ``@`` has one possible start, so the text is walked once from @ to @."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds, each leftmost and without overlaps of its own."""
    found = [("email", a, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return found
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text)
              if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text)
              if 10 <= len(digits_of(m[0])) <= 15]
    return found


def more_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("iban", m.start(), m.end()) for m in IBAN.finditer(text)
             if mod97(m[0].replace(" ", ""))]
    found += [("routing", m.start(), m.end()) for m in ROUTING.finditer(text)
              if routing_sum(m[0])]
    found += [("ssn", m.start(), m.end()) for m in SSN.finditer(text)]
    return found


def scored(text: str, kind: str, start: int, end: int) -> Span:
    near = set(WORD.findall(text[max(0, start - NEAR):start].lower())) | set(
        WORD.findall(text[end:end + NEAR].lower()))
    plain, sure = SCORES[kind]
    score = sure if near.intersection(CONTEXT[kind]) else plain
    return Span(kind, start, end, round(score - 0.2 * bool(near.intersection(AGAINST)), 3))


def spans(text: str) -> list[Span]:
    """All spans by start, then kind. Base spans always stay; others need a score of
    ``THRESHOLD`` and must not overlap a base span."""
    base = base_spans(text)
    more = []
    if re.search("[0-9]{2}", text):
        starts = sorted(x for _, x, _ in base)
        # How far the base spans reach that start first, for one look-up per further span.
        reach = list(accumulate((y for _, y in sorted((x, y) for _, x, y in base)), max, initial=0))
        for kind, a, b in more_spans(text):
            if reach[bisect_left(starts, b)] <= a:
                span = scored(text, kind, a, b)
                if span.score >= THRESHOLD:
                    more.append(span)
    out = [scored(text, *x) for x in base] + more
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(found: list[Span], kinds=KINDS) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found if s.kind in kinds)


def redacted(text: str) -> str:
    """The text with each run of overlapping spans replaced by its first one's kind."""
    out, at = [], 0
    for s in spans(text):
        if s.start >= at:
            out += [text[at:s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its spans with scores.

    A null text counts as empty and has none. A null id is carried along, equal rows
    give equal rows, and an empty table gives an empty one.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                               ("end", pa.int64()), ("score", pa.float64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[s._asdict() for s in spans(t)] for t in texts(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return map_batches(thin(docs, "doc_id", "text"), work,
                       "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def pii_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, and the spans as text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(t) for t in texts(batch)]
        counts = [pa.array([sum(s.kind == k for s in f) for f in found], pa.int64()) for k in BASE]
        digest = [hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array(digest, pa.string()),
             pa.array([joined(f) for f in found], pa.string())],
            ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return map_batches(
        thin(docs, "doc_id", "text"), work,
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with spans replaced in ``text``; ``n_chars`` follows where there is one.

    A null text stays null and an empty one empty. Ids are not looked at, rows that
    repeat are treated alike, and an empty table gives an empty one.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column("text").to_pylist()
        new = [None if t is None else redacted(t) for t in old]
        out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
        k = batch.schema.get_field_index("n_chars")
        if k >= 0:
            kept = batch.column("n_chars").to_pylist()
            sizes = [n if a == b else len(b) for n, a, b in zip(kept, old, new)]
            out = out.set_column(k, "n_chars", pa.array(sizes, batch.schema.field(k).type))
        return out

    return map_batches(docs, work, docs.schema)
