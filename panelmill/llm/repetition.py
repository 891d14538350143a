"""Quality rules from repetition coverage.

Words are numbered within a document and their n-grams get rolling hashes in numpy, for several lengths n.  Measured
is how many characters lie in n-grams that occur twice or more, and in lines that repeat.

Defined results: null text has no words; a text without words has zero coverage and fails the base rule; any length is
handled whole (time n log n); repeated rows give repeated rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, portions, texts_of

WORDS = re.compile(r"[^ \t-\r]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Limits:
    """Largest share of word characters inside duplicated n-grams, by n, and inside repeated lines."""

    ngram_share: tuple[tuple[int, float], ...] = ((3, 0.45), (5, 0.25), (7, 0.25), (10, 0.25))
    line_share: float = 0.30


def duplicated(ids: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words in n-word windows that occur twice or more, by rolling hash; the first one counts too."""
    inside = np.zeros(len(ids), bool)
    if len(ids) <= n:
        return inside
    seed = mix(ids.astype(np.uint64) + np.uint64(1))
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + seed[k : k + len(h)]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if same.any():
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        step = np.zeros(len(ids) + 1, np.int64)
        np.add.at(step, np.flatnonzero(twice), 1)
        np.add.at(step, np.flatnonzero(twice) + n, -1)
        inside = np.cumsum(step[:-1]) > 0
    return inside


def measure(text: str, limits: Limits) -> tuple:
    words = WORDS.findall(text)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = int(lengths.sum())
    seen: set[str] = set()
    n_lines = line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            own = WORDS.findall(line)
            n_lines += bool(own)
            line_chars += sum(map(len, own))
        seen.add(line)
    repeat = int(duplicated(ids, 5).sum())
    shares = [float(lengths[duplicated(ids, n)].sum()) / chars if chars else 0.0 for n, _ in limits.ngram_share]
    lines = line_chars / chars if chars else 0.0
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    fine = all(s <= most for s, (_, most) in zip(shares, limits.ngram_share)) and lines <= limits.line_share
    return len(words), chars, len(SYMBOLS.findall(text)), n_lines, repeat, failed, not failed and fine, lines, shares


def score_repetition(documents: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed and
    kept boolean, dup_line_share double, dup_ngram_shares array<double> in the order of the limits."""
    source = documents.select(F.col(key), F.col(text).alias("_text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share", "dup_ngram_shares"]
    types = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.float64())]
    kinds = [*["long"] * 5, "boolean", "boolean", "double", "array<double>"]
    schema = ", ".join([f"`{key}` {source.schema[0].dataType.simpleString()}", *(f"{n} {k}" for n, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            rows = [measure(text, limits) for text in texts_of(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], [key, *names])

    return source.mapInArrow(run, schema)
