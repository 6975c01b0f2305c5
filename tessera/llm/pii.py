"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust their score."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, slices, whole_text


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


#: Kinds in the order that breaks ties of start; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "secret")
BASE = KINDS[:4]

#: The base patterns' parts. A run is matched possessively and never from inside itself, which
#: changes no leftmost match and keeps the search linear in the text.
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Added kinds: pattern, score before context, context words (lower case) that raise it by CONTEXT_GAIN.
_IBAN = re.compile(r"(?<![A-Z0-9a-z])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+)(.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9+/_-]{32,}+")
CONTEXT = {
    "email": ("mail", "contact", "e-mail", "email"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "secret": ("token", "key", "secret", "password", "api_key", "apikey", "passwd"),
}
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "local_phone": 0.4, "secret": 0.2}
CONTEXT_GAIN, CONTEXT_CHARS, ACCEPT = 0.3, 40, 0.5
_WORD = re.compile(r"[^\W\d_]+(?:[-_][^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 check of an IBAN without spaces."""
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each '@' outwards: the run of local characters to its left, the dotted name to its right."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    """The base kinds, by start and then kind as listed. Failing matches are dropped without a retry."""
    found: list[Span] = []
    if "@" in text:
        found += [Span(a, b, "email", SCORES["email"]) for a, b in _emails(text)]
    if _ANY_DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
                    found.append(Span(*m.span(), "ip", SCORES["ip"]))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(Span(*m.span(), "card", SCORES["card"]))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(Span(*m.span(), "phone", SCORES["phone"]))
    return sorted(found, key=_order)


_ANY_DIGIT = re.compile(r"[0-9]")


def _order(s: Span) -> tuple[int, int, int]:
    return s.start, KINDS.index(s.kind), s.end


def _context(text: str, start: int, end: int, kind: str) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start].lower() + " " + text[end : end + CONTEXT_CHARS].lower()
    return CONTEXT_GAIN if any(w in CONTEXT[kind] for w in _WORD.findall(near)) else 0.0


def find_pii(text: str) -> list[Span]:
    """All spans of a text, ordered, with scores in [0, 1]. Base spans always stay; an added span stays if its
    checksum holds, its score with context reaches ACCEPT and it overlaps no base span."""
    base = base_spans(text)
    out = [s._replace(score=min(1.0, s.score + _context(text, s.start, s.end, s.kind))) for s in base]
    added: list[Span] = []
    if _ANY_DIGIT.search(text):
        for kind, pattern in (("iban", _IBAN), ("local_phone", _LOCAL_PHONE), ("secret", _SECRET)):
            for m in pattern.finditer(text):
                if kind == "iban" and not mod97(m[0].replace(" ", "")):
                    continue
                if kind == "secret" and not (_ANY_DIGIT.search(m[0]) and _LETTER.search(m[0])):
                    continue
                score = SCORES[kind] + _context(text, *m.span(), kind)
                if score >= ACCEPT:
                    added.append(Span(*m.span(), kind, min(1.0, score)))
    held = sorted((s.start, s.end) for s in out)
    for s in sorted(added, key=_order):
        i = bisect.bisect_left(held, (s.end, 0))  # what starts before s ends; base spans may nest, so look at a few
        if all(end <= s.start for _, end in held[max(0, i - len(KINDS)) : i]):
            held.insert(i, (s.start, s.end))
            out.append(s)
    return sorted(out, key=_order)


_LETTER = re.compile(r"[A-Za-z]")


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind's name in brackets."""
    parts, done = [], 0
    for s in spans:
        if s.start >= done:
            parts += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*parts, text[done:]])


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>, redacted string"


def detect_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end in code points, score), redacted text.

    One pass over each whole text without a shuffle. A null text counts as empty and has no spans; a null id
    is kept; repeated rows give repeated rows; other columns are ignored. Every pattern is linear in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            found = [find_pii(t) for t in texts]
            rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in f] for f in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            cleaned = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind), pa.array(cleaned, pa.string())], ["doc_id", "spans", "redacted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(lean(run), SCHEMA)


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs, all columns, with every span of its texts redacted and n_chars, if there is one, counted anew where
    the text changed. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            at = b.schema.get_field_index(text)
            before = b.column(at).to_pylist()
            after = [redact(t, find_pii(t)) if t else t for t in before]
            columns = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            columns[text] = pa.array(after, b.column(at).type)
            if n_chars in columns:
                counts = [len(y) if x != y else n for x, y, n in zip(before, after, columns[n_chars].to_pylist(), strict=True)]
                columns[n_chars] = pa.array(counts, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(lean(run), docs.schema)


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def span_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the counts of base spans, the digest of their list, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                spans = find_pii(t)
                base = [s for s in spans if s.kind in BASE]
                for i, kind in enumerate(BASE):
                    out[i].append(sum(s.kind == kind for s in base))
                out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[5].append(joined(spans))
            arrays = [pa.array(x, pa.int64()) for x in out[:4]] + [pa.array(x, pa.string()) for x in out[4:]]
            names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(lean(run), DIGEST)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(documents(spark, sf_dir))
