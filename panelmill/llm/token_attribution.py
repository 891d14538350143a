"""Token counts for sections by offset-mapped attribution.

A document is encoded once, as a whole.  The tokens' character spans are joined as intervals with the sections'
spans, and a token that crosses a boundary goes where the rule says:

``start``     the section that holds its first character (the default);
``majority``  the section that holds most of its bytes, the earlier one of equals;
``split``     every section it touches, by its share of the token's bytes.

Defined results: null and empty texts have one empty section 0; sections tile the text, so that a text's counts sum to
its tokens; repeated rows give repeated rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PORTION, encoder
from .common import portions, texts_of

RULES = ("start", "majority", "split")


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of tokens and sections, both tiling [0, n) and given by their ends in bytes: tokens of each
    section by the rule, tokens that touch it, and of those the ones that cross a boundary."""
    k, token_starts = len(section_ends), np.concatenate([[0], token_ends])[:-1].astype(np.int64)
    first = np.searchsorted(section_ends, token_starts, "right")
    last = np.maximum(np.searchsorted(section_ends, token_ends, "left"), first)
    pairs = last - first + 1  # sections of each token
    token = np.repeat(np.arange(len(token_ends)), pairs)
    section = np.repeat(first, pairs) + np.arange(len(token)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    section_starts = np.concatenate([[0], section_ends[:-1]])
    shared = np.minimum(token_ends[token], section_ends[section]) - np.maximum(token_starts[token], section_starts[section])
    touching = np.bincount(section, minlength=k)
    crossing = np.bincount(section, weights=(pairs > 1)[token], minlength=k).astype(np.int64)
    if rule == "start":
        given = np.bincount(first, minlength=k).astype(float)
    elif rule == "split":
        given = np.bincount(section, weights=shared / np.maximum(token_ends - token_starts, 1)[token], minlength=k)
    else:
        order = np.lexsort((section, -shared, token))
        best = order[np.cumsum(pairs) - pairs] if len(pairs) else order
        given = np.bincount(section[best], minlength=k).astype(float)
    return given, touching, crossing


def section_tokens(documents: DataFrame, path: str, pattern: str, boundary: str = r"\n", rule: str = "start", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each section of each document: key, section int, char_start and char_end long (code points, end
    exclusive), n_tokens double by the rule, n_touching and n_crossing long, doc_tokens long.  A section ends with each
    match of `boundary`, which belongs to it."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    source = documents.select(F.col(key), F.col(text).alias("_text"))
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, section int, char_start long, char_end long, n_tokens double, n_touching long, n_crossing long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ends_at = encoder(path, pattern), regex.compile(boundary)
        for batch in portions(batches, "_text", PORTION):
            texts = texts_of(batch, "_text")
            ids = own.encode_all(texts)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            inner = [[m.end() for m in ends_at.finditer(text) if 0 < m.end() < len(text)] for text in texts]
            ends = [np.unique(np.array([*own_ends, n], np.int64)) for own_ends, n in zip(inner, lengths.tolist())]
            n_sections = np.fromiter(map(len, ends), np.int64, len(texts))
            char_ends = np.concatenate(ends)  # in the own text
            which = np.repeat(np.arange(len(texts)), n_sections)
            first = np.cumsum(n_sections) - n_sections
            char_starts = np.concatenate([[0], char_ends[:-1]])
            char_starts[first] = 0
            raw = np.frombuffer("".join(texts).encode(), np.uint8)
            byte_of = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where each character of all texts begins
            begins = np.cumsum(lengths) - lengths
            # tokens and sections both tile the texts in a row, so one join serves them all
            counts = attribute(np.cumsum(own.size[ids.flat]), byte_of[(begins[which] + char_ends)], rule)
            section = np.arange(len(which)) - first[which]
            columns = [section, char_starts, char_ends, *counts, ids.count[which]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *(pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types))], [key, "section", "char_start", "char_end", "n_tokens", "n_touching", "n_crossing", "doc_tokens"])

    return source.mapInArrow(run, schema)
