"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier cues.  Around each
anchor a deterministic parser expands to the boundaries of its kind and validates the result.  A parser looks at the
anchor's neighbourhood alone, so the work follows the number of anchors, not the text's length times the kinds.

Base kinds, leftmost and non-overlapping within a kind, a failing match is dropped and not retried:
email, ip (parts at most 255), card (13 to 19 digits that pass Luhn), phone (9 to 15 digits).
The method adds: login (``scheme://user:password@``, the part between scheme and at-sign), account (an identifier of 6
to 34 characters with 4 or more digits after a cue, of which at most 12 more small letters, a word such as "no" and 4 marks
may follow) and secret (the value of 8 or more characters, one of
them a digit, that a cue such as ``password=`` assigns, and access keys that a known prefix opens).

Offsets are code points, the end exclusive.  Null text is empty; empty texts have no spans; any length is handled
whole; repeated rows give repeated rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, texts_of

#: The kinds in the order of the digest, and the words that announce an identifier.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account", "secret")
CUES = ("account", "acct", "iban", "ssn", "passport", "licence no", "license no", "tax id", "customer id")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey")
KEY_PREFIXES = ("AKIA", "ASIA")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")
IDENTIFIER = re.compile(r"[a-z]{0,12}[ ]?(?:no|nr|number|id)?[ .:#=\"']{0,4}([A-Z0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
SECRET = re.compile(r"[ ]?[=:][ ]?[\"']?([A-Za-z0-9+/_.-]{8,})")
KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, kind in [("@", "@"), ("+", "+"), *((d, "d") for d in "0123456789"), *((s, "s") for s in SCHEMES), *((k, "k") for k in KEY_PREFIXES), *((c, mark) for cues, mark in ((CUES, "c"), (SECRET_CUES, "w")) for cue in cues for c in {cue, cue.upper(), cue.capitalize()})]:
        found.add_word(text, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def spans_of(text: str) -> list[Span]:
    """All spans by kind as listed in KINDS, then start."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where each kind may start again

    def keep(kind: str, start: int, end: int, valid: bool = True) -> None:
        past[kind] = end
        if valid:
            found[kind].append((kind, start, end))

    for last, kind in _anchors().iter(text):
        if kind == "@":
            if last >= past["email"] and (span := _email(text, last, past["email"])):
                keep("email", *span)
        elif kind == "+":
            if last >= past["phone"] and (m := PHONE.match(text, last)):
                keep("phone", last, m.end(), 9 <= sum(c in DIGITS for c in m[0]) <= 15)
        elif kind == "d":
            inside = last and text[last - 1] in DIGITS
            if last >= past["card"] and (m := NUMBER.match(text, last)):
                digits = re.sub("[ -]", "", m[0])
                keep("card", last, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
            if last >= past["ip"] and (not inside or last == past["ip"]) and (m := ADDRESS.match(text, last)):
                keep("ip", last, m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")))
        elif kind == "s":
            if last >= past["login"] and (m := LOGIN.match(text, last + 1)):
                keep("login", last + 1, m.end())
        elif kind == "w":
            if last >= past["secret"] and (m := SECRET.match(text, last + 1)) and any(c in DIGITS for c in m[1]):
                keep("secret", *m.span(1))
        elif kind == "k":
            start = last - 3
            if start >= past["secret"] and not text[start - 1 : start].isalnum() and KEY.match(text, last + 1):
                keep("secret", start, last + 17)
        elif last >= past["account"] and (m := IDENTIFIER.match(text, last + 1)) and sum(c in DIGITS for c in m[1]) >= 4:
            keep("account", *m.span(1))
    return [span for kind in KINDS for span in found[kind]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans."""
    source = documents.select(F.col(key), F.col(text).alias("_text"))
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            rows = []
            for text in texts_of(batch, "_text"):
                spans = spans_of(text)
                base = [s for s in spans if s[0] in BASE_KINDS]
                rows.append((*(sum(s[0] == kind for s in base) for kind in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return source.mapInArrow(run, schema)


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced, under the
    kind of the one that starts first."""
    out, at = [], 0
    for kind, start, end in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with the text redacted; null stays null."""
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            new = pa.array([t if t is None else redacted(t) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], new, *batch.columns[place + 1 :]], batch.schema.names)

    return documents.mapInArrow(run, documents.schema)
