"""Repeated passages by MinHash banding of paragraphs and by winnowed word runs.

Paragraphs are lines of 24 words or more.  Those with equal words are one from the start; others are banded by MinHash
over five-word shingles (6 bands of 2 rows: 99.8 % recall at similarity 0.8), colliding ones are verified by exact Jaccard
similarity, and verified links are clustered by components.  A paragraph of a class that spans two documents or more is
repeated.

A passage that is set into other paragraphs, or into short lines, is found by equal words: each run of 13 words has a
hash, and of every 12 runs in a row the least one (the last of equal ones) is kept as a print.  A text of 24 words that
two documents share therefore shares a print, in whatever paragraphs it stands.  Prints of two documents or more are
repeated; kept ones follow each other within 12 words, so they leave no gap.  Where the prints of a class don't all have
the same neighbour, the 11 runs on that side are compared too, in all documents of the class, which extends a hit word by
word to its ends.  Nothing is paired, so the work doesn't grow with the square of a class.

A passage is a run of repeated paragraphs and word runs of a document with 24 words or more; those with fewer than 6
words between them are one.  The first occurrence of a class (smallest doc_id, then word) stays, others are removals.
Every text of 24 or more equal words is found; one with changed words is found by its equal runs, and as a whole where its
paragraphs are similar at 0.8.

Defined results: null, empty and short texts have no passages; texts are handled whole; rows that repeat a doc_id
count as one document, and a row has the passages of its own text, once for each distinct text; a document without
passages, or without a doc_id, has no row; doc_id may have any type with an order; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BASE, Hashed, Words, binaries_of, cut_lineage, let_go, lists_of, mix, portions, ranges, texts_of, words_of
from .links import near_links
from .neardup import SHINGLE, THRESHOLD, lists_of_keys

#: Least words of a paragraph and of a passage; words between repeated parts that are one passage; bands and their rows.
PASSAGE_WORDS, GAP_WORDS, BANDS, ROWS = 24, 6, 6, 2
#: Words of a print, and of how many runs in a row one is kept: PASSAGE_WORDS equal words always hold one.
PRINT, WINDOW = 13, 12
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last word (end exclusive, places in the row of all words) of each line of enough words."""
    starts = words.breaks.copy()
    starts[words.first[:-1][words.counts > 0]] = True
    a = np.flatnonzero(starts)
    b = np.append(a[1:], len(words.hash))[: len(a)]
    own = b - a >= PASSAGE_WORDS
    a, b = a[own], b[own]
    return np.searchsorted(words.first, a, "right") - 1, a, b


def _bands(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = np.arange(len(words.hash) - SHINGLE + 1)
    g = np.append(Hashed(words.hash).of(at, at + SHINGLE), np.uint64(0))
    limits = np.column_stack([a, b - SHINGLE + 1]).ravel()
    keys = np.zeros((len(a), BANDS), np.uint64)
    for k, seed in enumerate(SEEDS):
        least = np.minimum.reduceat(mix(g ^ seed), limits)[::2]
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] * np.uint64(BASE) + least + np.uint64(k))
    return keys.view(np.int64)


def occurrences_of(documents: DataFrame) -> DataFrame:
    """A row for each paragraph: id (hash of the words), doc_id, text_key, first_word, last_word (end exclusive), size
    (distinct shingles) and bands.  documents: doc_id, text_key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 500_000):
            words = words_of(texts_of(batch))
            text, a, b = paragraphs(words)
            if len(a):
                of = pa.array(text)
                sizes = [len(np.unique(s)) for s in _shingles(words, a, b)]
                own = [pa.array(x.astype(np.int32)) for x in (a - words.first[text], b - words.first[text])]
                yield pa.RecordBatch.from_arrays([pa.array(Hashed(words.hash).of(a, b).view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), *own, pa.array(sizes, pa.int64()), lists_of_keys(_bands(words, a, b))], ["id", "doc_id", "text_key", "first_word", "last_word", "size", "bands"])

    return documents.select("doc_id", "text_key", "text").mapInArrow(run, f"id long, doc_id {documents.schema['doc_id'].dataType.simpleString()}, text_key long, first_word int, last_word int, size long, bands array<long>")


def _shingles(words: Words, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    at = ranges(a, b - a - SHINGLE + 1)
    return np.split(Hashed(words.hash).of(at, at + SHINGLE), np.cumsum(b - a - SHINGLE + 1)[:-1])


def _sets(documents: DataFrame) -> DataFrame:
    """id and shingles of some paragraphs.  documents: text and wanted, an array of (id, first_word, last_word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 500_000):
            words = words_of(texts_of(batch))
            wanted = batch.column("wanted")
            base = np.repeat(words.first[:-1], wanted.value_lengths().to_numpy(zero_copy_only=False))
            ids, a, b = wanted.flatten().flatten()
            a, b = (base + x.to_numpy(zero_copy_only=False) for x in (a, b))
            sets = [np.unique(s) for s in _shingles(words, a, b)]
            yield pa.RecordBatch.from_arrays([ids, binaries_of(np.concatenate(sets), np.array([len(s) for s in sets]))], ["id", "shingles"])

    return documents.select("text", "wanted").mapInArrow(run, "id long, shingles binary")


def near_paragraphs(documents: DataFrame) -> DataFrame:
    """Paragraphs of classes that span two documents or more: doc_id, text_key, first_word, last_word (end exclusive),
    class_id and removed.  documents: doc_id, text_key, text."""
    occurrences = cut_lineage(occurrences_of(documents))
    place = F.struct("doc_id", "text_key", "first_word", "last_word")
    own = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(place).alias("first")]
    each = cut_lineage(occurrences.groupBy("id").agg(*own, F.first("size").alias("size"), F.first("bands").alias("bands")))

    def sets_of(ids: DataFrame) -> DataFrame:
        at = each.join(ids, "id").select("id", "first.*").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("id", "first_word", "last_word")).alias("wanted"))
        texts = documents.join(at, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
        return _sets(texts)

    links, found = near_links(each.select(F.explode("bands").alias("key"), "id", "size"), sets_of, THRESHOLD)
    linked = each.drop("bands", "size").join(found, "id", "left").where((F.col("lo") != F.col("hi")) | F.col("component").isNotNull())
    linked = cut_lineage(linked.withColumn("class_id", F.coalesce("component", "id")))
    classes = linked.groupBy("class_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("kept")).where("lo <> hi")
    hits = occurrences.drop("bands", "size").join(linked.select("id", "class_id").join(classes.select("class_id", "kept"), "class_id"), "id")
    hits = cut_lineage(hits.select("doc_id", "text_key", "first_word", "last_word", "class_id", (place != F.col("kept")).alias("removed")).distinct())
    let_go(occurrences, each, linked)
    return hits


def winnowed(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the least hash of every WINDOW in a row of a text, the last of equal ones; of all where a text has
    fewer.  counts: hashes of each text, which follow each other in h."""
    at, span, least = np.arange(len(h)), 1, lambda a, b: np.where(h[b] <= h[a], b, a)
    while span < min(WINDOW, len(h)):
        step = min(span, WINDOW - span)
        at = least(at[:-step], at[step:]) if step < len(at) else at[:0]
        span += step
    ends = np.cumsum(counts)
    whole = at[ranges((ends - counts)[counts >= WINDOW], counts[counts >= WINDOW] - WINDOW + 1)]
    short = [b - 1 - int(np.argmin(h[a:b][::-1])) for a, b in zip((ends - counts).tolist(), ends.tolist()) if 0 < b - a < WINDOW]
    return np.unique(np.concatenate([whole, np.array(short, np.int64)]))


def _prints(documents: DataFrame) -> DataFrame:
    """A row for each document of PRINT words or more: doc_id, text_key and the lists print (hash), word and link, which
    tells a print's neighbours and their distance and has one entry more; 0 at both ends.  Where documents has the lists
    lefts and rights (words), the prints are all runs on that side of them up to WINDOW - 1 words away, without links."""
    sided = "lefts" in documents.columns
    names = ["doc_id", "text_key", "print", "word", "link"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.arange(1, WINDOW)
        for batch in portions(batches, "text", 500_000):
            words = words_of(texts_of(batch))
            counts = np.maximum(words.counts - PRINT + 1, 0)
            at = ranges(words.first[:-1], counts)
            if not len(at):
                continue
            h, begins = Hashed(words.hash).of(at, at + PRINT), np.cumsum(counts) - counts
            if sided:
                parts = []
                for c, sign in (("lefts", -1), ("rights", 1)):
                    column = batch.column(c)
                    text = np.repeat(np.arange(len(counts)), column.value_lengths().to_numpy(zero_copy_only=False))
                    near = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[:, None] + sign * around
                    inside = (near >= 0) & (near < counts[text][:, None])
                    parts.append((near + begins[text][:, None])[inside])
                own = np.unique(np.concatenate(parts))
            else:
                own = winnowed(h, counts)
            text = np.searchsorted(np.cumsum(counts), own, "right")
            n = np.bincount(text, minlength=len(counts))
            word = (own - begins[text]).astype(np.int32)
            between = np.zeros(len(own) + 1, np.uint64)
            if len(own) and not sided:
                between[1:-1] = np.where(text[1:] == text[:-1], mix(h[own][:-1] * np.uint64(BASE) + h[own][1:] + np.diff(own).astype(np.uint64)), np.uint64(0))
            links = np.concatenate([between[:-1], between[-1:]])[ranges(np.cumsum(n) - n, n + (n > 0))]
            some = pa.array(np.flatnonzero(n))
            lists = [lists_of(h[own].view(np.int64), n), lists_of(word, n), lists_of(links.view(np.int64), n + (n > 0))]
            yield pa.RecordBatch.from_arrays([x.take(some) for x in (batch.column("doc_id"), batch.column("text_key"), *lists)], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, text_key long, print array<long>, word array<int>, link array<long>")


def equal_runs(documents: DataFrame) -> DataFrame:
    """Word runs that stand in two documents or more: doc_id, text_key, first_word, last_word (end exclusive), class_id
    and removed.  Runs of a document that overlap or touch are one, apart from first occurrences.  documents: doc_id,
    text_key, text."""
    kept = cut_lineage(_prints(documents.select("doc_id", "text_key", "text")))
    bounds = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")]
    shared = cut_lineage(kept.select("doc_id", F.explode("print").alias("print")).groupBy("print").agg(*bounds).where("lo <> hi").select("print"))
    n = F.size("print")
    zipped = F.arrays_zip("print", "word", F.slice("link", F.lit(1), n).alias("before"), F.slice("link", F.lit(2), n).alias("after"))
    hits = cut_lineage(kept.select("doc_id", "text_key", F.inline(zipped).alias("print", "word", "before", "after")).join(shared, "print"))
    let_go(kept, shared)
    first = F.min(F.struct("doc_id", "word")).alias("first")
    sides = [(F.min(c) != F.max(c)).alias(side) for c, side in (("before", "left"), ("after", "right"))]
    classes = cut_lineage(hits.groupBy("print").agg(first, *sides))
    words = [F.collect_set(F.when(F.col(side), F.col("word"))).alias(f"{side}s") for side in ("left", "right")]
    edges = hits.join(classes.where("left OR right"), "print").groupBy("doc_id", "text_key").agg(*words)
    more = _prints(documents.join(edges, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "lefts", "rights"))
    more = cut_lineage(more.select("doc_id", "text_key", F.inline(F.arrays_zip("print", "word")).alias("print", "word")).distinct())
    beyond = more.join(more.groupBy("print").agg(first, *bounds).where("lo <> hi").drop("lo", "hi"), "print")
    columns = ["doc_id", "text_key", "word", "print", "first"]
    every = hits.join(classes, "print").select(*columns).unionByName(beyond.select(*columns))
    removed = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("word") != F.col("first.word"))
    every = every.select("doc_id", "text_key", F.col("word").alias("first_word"), (F.col("word") + PRINT).alias("last_word"), F.col("print").alias("class_id"), removed.alias("removed"))
    runs = _runs(every, ["doc_id", "text_key", "removed"], 0).groupBy("doc_id", "text_key", "removed", "run")
    runs = cut_lineage(runs.agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min_by("class_id", F.struct("first_word", "class_id")).alias("class_id")).drop("run"))
    let_go(hits, classes, more)
    return runs


def _runs(parts: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Adds run: parts of one `by` with no more than `gap` words between them have one number."""
    order = W.partitionBy(*by).orderBy("first_word", "last_word", "class_id")
    before = F.max("last_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("before", before).withColumn("new", F.coalesce((F.col("first_word") > F.col("before") + gap).cast("int"), F.lit(1)))
    return parts.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))


def _with_places(documents: DataFrame) -> DataFrame:
    """doc_id and the passages with start and end (code points).  documents: doc_id, text, passages."""
    schema = documents.select("doc_id", "passages").schema
    kinds = schema["passages"].dataType.elementType.simpleString().replace("struct<", "struct<start:bigint,end:bigint,", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 500_000):
            words, lists = words_of(texts_of(batch)), batch.column("passages")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            fields = lists.flatten()
            a, b = (np.repeat(words.first[:-1], n) + fields.field(c).to_numpy(zero_copy_only=False) for c in ("first_word", "last_word"))
            names = [f.name for f in fields.type]
            own = pa.StructArray.from_arrays([pa.array(words.start[a]), pa.array(words.end[b - 1]), *(fields.field(c) for c in names)], ["start", "end", *names])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), own)], ["doc_id", "passages"])

    return documents.select("doc_id", "text", "passages").mapInArrow(run, f"doc_id {schema['doc_id'].dataType.simpleString()}, passages array<{kinds}>")


def repeated_passages(documents: DataFrame) -> DataFrame:
    """A row for each passage of a document: doc_id, start, end (code points), class_id (of its first part),
    n_paragraphs (repeated paragraphs and word runs), n_words (repeated words), n_removed (parts that aren't the first
    occurrence), removed (any of them)."""
    documents = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    parts = near_paragraphs(documents).unionByName(equal_runs(documents))
    runs = _runs(parts, ["doc_id", "text_key"], GAP_WORDS - 1)
    fresh = F.greatest(F.col("last_word") - F.greatest("first_word", F.coalesce("before", F.lit(0))), F.lit(0)).cast("long")
    found = runs.withColumn("words", fresh).groupBy("doc_id", "text_key", "run").agg(
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min_by("class_id", F.struct("first_word", "last_word", "class_id")).alias("class_id"),
        F.count(F.lit(1)).alias("n_paragraphs"), F.sum("words").alias("n_words"), F.count_if("removed").alias("n_removed"),
    )
    found = found.where(F.col("n_words") >= PASSAGE_WORDS).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first_word", "last_word", "class_id", "n_paragraphs", "n_words", "n_removed")).alias("passages"))
    texts = documents.join(found, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.first("passages").alias("passages"))
    placed = _with_places(texts).select("doc_id", F.inline("passages"))
    return placed.select("doc_id", "start", "end", "class_id", "n_paragraphs", "n_words", "n_removed", (F.col("n_removed") > 0).alias("removed"))
