"""Near-duplicate documents by ProbMinHash.

A document's shingles are five words each.  Every distinct one is a Poisson process of weight 1; each arrival falls into a
random register, which keeps its earliest arrival.  A shingle stops as soon as its time is past the latest register.
Registers of two documents agree with the probability Jaccard similarity, which for equal weights is the Jaccard
similarity of the shingle sets.  Registers are cut into bands; documents that collide are verified by that same similarity,
worked out exactly, so a repeated block doesn't keep a pair from being proposed.

Exact copies (equal words) are one text from the start, known by a 128-bit hash of the words, so a group of copies
costs one row of a map-side sum.

Defined results: a document's words are its lower-case runs of word characters; one with fewer than five words has
one shingle; a row with a null, empty or wordless text is a class of its own (all such rows of one doc_id); each row
belongs to the class of its own text, so rows that repeat a doc_id with different texts may differ; class_id is the
smallest doc_id of the class, so ties don't depend on order, and null only where the class has no doc_id; doc_id may
have any type with an order; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Hashed, Words, binaries_of, cut_lineage, let_go, mix, portions, shingles_of, texts_of, words_of
from .links import near_links

THRESHOLD, SHINGLE, BANDS, ROWS = 0.8, 5, 28, 5


def prob_minhash(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers array of the elements that came first.  owner: the document of each element, ascending."""
    first = np.full((n, registers), np.iinfo(np.uint64).max, np.uint64)  # time as float32 bits, then the element
    time, active, turn = np.zeros(len(hashes)), np.arange(len(hashes)), 0
    element, flat = hashes & np.uint64(0xFFFFFFFF), first.reshape(-1)
    while len(active):
        turns = np.arange(turn + 1, turn + 1 + min(max(20_000 // len(active), 1), 64), dtype=np.uint64)[:, None]  # several arrivals at once where few are at work
        turn += len(turns)
        draw = mix(hashes[active] + turns * np.uint64(BASE))
        wait = np.log(((draw >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / -weights[active]
        arrival = np.cumsum(np.concatenate([time[None, active], wait]), axis=0)[1:]
        time[active] = arrival[-1]
        bits = arrival.astype(np.float32).view(np.uint32).astype(np.uint64)
        slot = owner[active] * registers + ((draw & np.uint64(0x3FFFFF)) * np.uint64(registers) >> np.uint64(22)).astype(np.int64)
        np.minimum.at(flat, slot.ravel(), (bits << np.uint64(32) | element[active]).ravel())
        change = np.flatnonzero(np.diff(owner[active], prepend=-1))  # documents that are still at work
        latest = first[owner[active][change]].max(axis=1) >> np.uint64(32)
        active = active[bits[-1] <= np.repeat(latest, np.diff(change, append=len(active)))]  # later arrivals can't come first
    return first & np.uint64(0xFFFFFFFF)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(registers), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + registers[:, r::rows][:, :bands] + np.uint64(r))
    return mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def content_hashes(words: Words) -> np.ndarray:
    """A 128-bit hash of each text's words, as two columns; equal for texts of equal words."""
    a, b = words.first[:-1], words.first[1:]
    return np.column_stack([Hashed(words.hash).of(a, b), Hashed(mix(words.hash ^ np.uint64(BASE))).of(a, b)])


def signatures(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (64-bit hash of the text), content (128-bit hash of the words), size (distinct shingles) and
    bands of every row; content is null and the others 0 and null without words."""
    source = documents.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text", 500_000):
            words = words_of(texts_of(batch, "_text"))
            hashes, sizes = shingles_of(words, SHINGLE)
            some = sizes > 0
            owner = np.repeat(np.cumsum(some) - 1, sizes)
            registers = prob_minhash(hashes, np.ones(len(hashes)), owner, int(some.sum()), BANDS * ROWS)  # equal weights: a link is defined by sets
            at = pa.array(np.where(some, np.cumsum(some) - 1, 0), mask=~some)
            keys = lists_of_keys(band_keys(registers, BANDS, ROWS)).take(at)
            contents = binaries_of(content_hashes(words)[some].ravel(), np.full(int(some.sum()), 2)).take(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), contents, pa.array(sizes), keys], ["doc_id", "text_key", "content", "size", "bands"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, text_key long, content binary, size long, bands array<long>")


def lists_of_keys(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id and shingles (ascending 64-bit numbers as bytes) of the rows' texts.  texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 500_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries_of(*shingles_of(words_of(texts_of(batch)), SHINGLE))], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, shingles binary")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of documents: doc_id, class_id, n_search_links (links of its text with different texts that
    the search used on its way to the classes, 0 for texts without a link; no count of all links of a text), text_key
    (64-bit hash of the text) and class_key (the class's smallest 128-bit content hash; null without words)."""
    source = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    signed = cut_lineage(signatures(source))
    holder = F.min(F.struct("doc_id", "text_key")).alias("holder")  # any holder will do
    own = [F.min("doc_id").alias("least"), holder, F.first("size").alias("size"), F.first("bands").alias("bands")]
    texts = cut_lineage(signed.where("content IS NOT NULL").groupBy(F.col("content").alias("id")).agg(*own))

    repeated = not signed.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()  # else a holder is one row

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = texts.select("id", "holder").join(ids, "id").select("id", F.col("holder.doc_id").alias("doc"), F.col("holder.text_key").alias("text_key"))
        read = source.withColumn("key", F.xxhash64("text")).join(wanted, F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")))
        return shingle_sets(read.groupBy("id").agg(F.first("text").alias("text")) if repeated else read)

    links, found = near_links(texts.select(F.explode("bands").alias("key"), "id", "size"), sets_of, THRESHOLD)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_search_links"))
    linked = texts.select("id", "least").join(found, "id").join(degree, "id", "left")
    least = linked.groupBy("component").agg(F.min("least").alias("class_id"))
    classes = texts.select("id", "least").join(linked.join(least, "component").select("id", "component", "class_id", "n_search_links"), "id", "left")
    classes = classes.select("id", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("component", "id").alias("class_key"), "n_search_links")
    classes = cut_lineage(classes)
    let_go(texts)
    placed = signed.select("doc_id", "text_key", "content").join(classes.withColumnRenamed("id", "content"), "content", "left")
    own_class = F.when(F.isnull("content"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return placed.select("doc_id", own_class, F.coalesce("n_search_links", F.lit(0)).cast("long").alias("n_search_links"), "text_key", "class_key")
