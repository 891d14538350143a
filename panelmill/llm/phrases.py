"""Collocations by relational mining: occurrences of frequent phrases are joined with their right neighbours, length by length.

The relation of a length has a tuple (piece, position, group) for each occurrence.  It is kept as sorted columns of a
portion of pieces: a bit for each place that holds an occurrence, with a bit left free between pieces, and the group of
each.  So the merge join of neighbours is a comparison of columns within a portion, and a group goes into the group-count
once for each portion, however often it stands there: no word, however frequent, makes a hot key.  The relation is written,
groups are counted over all portions, and occurrences of groups below `least` leave by a semi-join before the next length.
A group of k + 1 words is a pair of groups of k words that overlap; groups are compared and numbered exactly.  Pairs are
dealt by hash into buckets of about `BUCKET` pairs, as compressed columns of what a portion has in a bucket.

Words are runs without blanks in pieces between punctuation and line ends, A-Z lower-cased.  Defined results: null and
empty texts have no words, a null lang is `und`, repeated rows count as often as they stand, an empty table has no
phrases, and texts of any length are cut into portions where pieces end; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, let_go, lists_of, mix, portions, released, squeezed, texts_of

ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
END = re.compile(f"[{ENDS.decode()}]")
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(ENDS)] = 1, 2

#: Bytes of text in a portion of one language, and in all that a task gathers.
PORTION, GATHERED = 6_000_000, 24_000_000
BUCKET = 1_000_000
TOP_SALTS = 64
WORDS = "lang string, portion long, words array<string>, counts array<long>, codes binary, places binary"
#: pairs: squeezed left, right and count of each group of the portion; codes: the group of each occurrence.
PAIRS = "portion long, n_pairs long, pairs binary, codes binary, places binary"
COUNTED = "portion long, at binary, gid array<long>, a array<long>, left array<long>, right array<long>"


def pieces_of(text: str, most: int) -> Iterator[str]:
    """The text, or if it is longer than a portion, parts of it that end where pieces do."""
    at = 0
    while len(text) - at > most and (end := END.search(text, at + most)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:] if at else text


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the number of each occurrence's word, and its place: one after the one before, or two where a
    piece begins."""
    data = np.frombuffer("\n".join(texts).encode().lower(), np.uint8)
    kind = KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    ends = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int32)])[start]
    place = np.arange(len(start), dtype=np.int64)
    place[1:] += np.cumsum(ends[1:] != ends[:-1])
    letters, bounds = np.ascontiguousarray(data[kind == 0]), np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    every = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    return every.dictionary.cast(pa.string()), every.indices.to_numpy(zero_copy_only=False), place


def kept_columns(codes: np.ndarray, place: np.ndarray) -> dict[str, pa.Array]:
    bits = np.zeros(int(place[-1]) + 1 if len(place) else 0, bool)
    bits[place] = True
    return {"codes": pa.array([squeezed(codes)], pa.binary()), "places": pa.array([zstandard.compress(np.packbits(bits).tobytes())], pa.binary())}


def first_relation(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Portions of one language each: a task gathers texts until a portion is full."""
    waiting: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    task, made = TaskContext.get().partitionId(), 0

    def portion(lang: str) -> pa.RecordBatch:
        nonlocal made
        size.pop(lang)
        words, codes, place = words_of(waiting.pop(lang))
        counts = np.bincount(codes, minlength=len(words)).astype(np.int64)
        made += 1
        one = np.array([len(words)])
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([lang]), "portion": pa.array([(task << 32) + made], pa.int64()), "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
            "counts": lists_of(counts, one), **kept_columns(codes, place),
        })

    for batch in portions(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
            for part in pieces_of(text, most):
                waiting.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
                if size[lang] >= most:
                    yield portion(lang)
            if sum(size.values()) >= GATHERED:
                yield portion(max(size, key=size.get))
    for lang in list(waiting):
        yield portion(lang)


def neighbours_joined(relation: pa.Table, groups: pa.Table) -> pa.Table:
    """The next length's relation of a portion, from its relation and the numbers of its frequent groups."""
    shape = pa.schema([("portion", pa.int64()), ("n_pairs", pa.int64()), ("pairs", pa.binary()), ("codes", pa.binary()), ("places", pa.binary())])
    if not relation.num_rows or not groups.num_rows:
        return shape.empty_table()
    codes = released(relation["codes"][0].as_py())[0]
    place = np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.decompress(relation["places"][0].as_py()), np.uint8)))
    at, number = np.concatenate([released(g, 2) for g in groups["at"].to_pylist()], axis=1)
    order = np.argsort(at)
    number, at = number[order], at[order]
    local = np.full(int(codes.max(initial=-1)) + 1, -1, np.int64)
    local[at] = np.arange(len(at))
    own = local[codes]
    own, place = own[own >= 0], place[own >= 0]  # the semi-join
    near = np.flatnonzero(place[1:] == place[:-1] + 1)  # the merge join
    pairs, codes, counts = np.unique(own[near] * len(at) + own[near + 1], return_inverse=True, return_counts=True)
    columns = {"n_pairs": pa.array([len(pairs)], pa.int64()), "pairs": pa.array([squeezed(number[pairs // len(at)], number[pairs % len(at)], counts)], pa.binary()), **kept_columns(codes, place[near])}
    return pa.Table.from_pydict({"portion": relation["portion"], **columns}, schema=shape)


def frequent_words(relation: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Words that occur `least` times or more: portion and at (squeezed places in the portion's words, and numbers); and
    gid (the number), a (occurrences), lang and word.  Words are dealt by hash into buckets, as compressed columns of what
    a portion has in a bucket."""
    buckets = max(1, -(-(relation.agg(F.sum(F.size("words"))).first()[0] or 0) // BUCKET))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, portion, words, counts = (batch.column(c)[i] for c in ("lang", "portion", "words", "counts"))
                words, counts = words.values, counts.values.to_numpy()
                hashed = np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.int64, len(words))
                order = np.argsort(hashed % buckets, kind="stable")  # at ascends within a bucket
                names, first = np.unique(hashed[order] % buckets, return_index=True)
                for bucket, at in zip(names, np.split(order, first[1:])):
                    text = zstandard.compress(b" ".join(w.encode() for w in words.take(pa.array(at)).to_pylist()))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket]), "lang": pa.array([lang.as_py()]), "portion": pa.array([portion.as_py()]), "part": pa.array([squeezed(counts[at], np.diff(at, prepend=0))], pa.binary()), "text": pa.array([text], pa.binary())})

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [released(p, 2) for p in rows["part"].to_pylist()]
        portions, langs = rows["portion"].to_numpy(), rows["lang"].combine_chunks().dictionary_encode()
        words = pa.array([w for t in rows["text"].to_pylist() for w in zstandard.decompress(t).decode().split(" ")]).dictionary_encode()
        sizes = [p.shape[1] for p in parts]
        owner, at, count = np.repeat(np.arange(len(parts)), sizes), np.concatenate([np.cumsum(p[1]) for p in parts]), np.concatenate([p[0] for p in parts])
        both = np.repeat(langs.indices.to_numpy(), sizes).astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
        groups, of = np.unique(both, return_inverse=True)
        a = np.zeros(len(groups), np.int64)
        np.add.at(a, of, count)
        kept = a >= least
        gid = np.where(kept, (key[0].as_py() << 36) + np.cumsum(kept), -1)
        stay = np.flatnonzero(gid[of] >= 0)
        own, ends = np.unique(owner[stay], return_index=True)  # owners ascend
        maps = [squeezed(at[i], gid[of[i]]) for i in (np.split(stay, ends[1:]) if len(own) else [])]
        n, none = len(own), int(kept.sum())
        found = groups[kept]
        return pa.table({
            "portion": pa.array([*portions[own].tolist(), *[None] * none], pa.int64()), "at": pa.array([*maps, *[None] * none], pa.binary()), "gid": pa.array([*[None] * n, *gid[kept].tolist()], pa.int64()),
            "a": pa.array([*[None] * n, *a[kept].tolist()], pa.int64()), "lang": pa.concat_arrays([pa.nulls(n, pa.string()), langs.dictionary.take(pa.array(found // len(words.dictionary)))]),
            "word": pa.concat_arrays([pa.nulls(n, pa.string()), words.dictionary.take(pa.array(found % len(words.dictionary)))]),
        })

    by_bucket = relation.select("lang", "portion", "words", "counts").mapInArrow(dealt, "bucket long, lang string, portion long, part binary, text binary").groupBy("bucket")
    rows = cut_lineage(by_bucket.applyInArrow(counted, "portion long, at binary, gid long, a long, lang string, word string"))
    return rows.where("portion IS NOT NULL").select("portion", "at"), rows.where("portion IS NULL").select("gid", "a", "lang", "word")


def frequent_pairs(relation: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The same of pairs: portion and at; and gid, a, left and right."""
    buckets = max(1, -(-(relation.agg(F.sum("n_pairs")).first()[0] or 0) // BUCKET))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion, pairs in zip(batch.column("portion").to_pylist(), batch.column("pairs").to_pylist()):
                left, right, count = released(pairs, 3)
                to = (mix(left.view(np.uint64) ^ mix(right.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")  # left and at ascend within a bucket
                names, first = np.unique(to[order], return_index=True)
                parts = [squeezed(np.diff(left[i], prepend=0), right[i], count[i], np.diff(i, prepend=0)) for i in np.split(order, first[1:])]
                if len(order):
                    yield pa.RecordBatch.from_pydict({"bucket": names, "portion": np.full(len(names), portion), "part": pa.array(parts, pa.binary())})

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        portions = rows["portion"].to_numpy()
        parts = [released(p, 4) for p in rows["part"].to_pylist()]
        left, at = (np.concatenate([np.cumsum(p[k]) for p in parts]) for k in (0, 3))
        right, count = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        owner = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
        order = np.lexsort((right, left))
        new = np.ones(len(order), bool)
        new[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
        first = np.flatnonzero(new)
        a = np.add.reduceat(count[order], first)
        kept = a >= least
        gid = np.where(kept, (key[0].as_py() << 36) + np.cumsum(kept), -1)
        of = np.empty(len(order), np.int64)
        of[order] = gid[np.cumsum(new) - 1]
        stay = np.flatnonzero(of >= 0)
        own, ends = np.unique(owner[stay], return_index=True)  # owners ascend
        maps = [squeezed(at[i], of[i]) for i in (np.split(stay, ends[1:]) if len(own) else [])]
        groups = [gid[kept], a[kept], left[order][first][kept], right[order][first][kept]]
        none = pa.nulls(len(own), pa.list_(pa.int64()))
        lists = [pa.concat_arrays([none, lists_of(g, np.array([len(g)]))]) for g in groups]
        return pa.table({"portion": pa.array([*portions[own].tolist(), None], pa.int64()), "at": pa.array([*maps, None], pa.binary()), **dict(zip(("gid", "a", "left", "right"), lists))})

    by_bucket = relation.select("portion", "pairs").mapInArrow(dealt, "bucket long, portion long, part binary").groupBy("bucket")
    rows = cut_lineage(by_bucket.applyInArrow(counted, COUNTED))
    groups = rows.where("portion IS NULL").select(F.inline(F.arrays_zip("gid", "a", "left", "right")))
    return rows.where("portion IS NOT NULL").select("portion", "at"), groups


def relations(documents: DataFrame, least: int, longest: int, portion: int = PORTION) -> tuple[DataFrame, list[DataFrame]]:
    """lang and n, all its words; and the frequent groups of each length."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    relation = cut_lineage(documents.select("text", lang).mapInArrow(lambda batches: first_relation(batches, portion), WORDS))
    totals = cut_lineage(relation.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    maps, groups = frequent_words(relation, least)
    found = [groups]
    for _ in range(longest - 1):
        before = relation.select("portion", "codes", "places").groupBy("portion")
        longer = cut_lineage(before.cogroup(maps.groupBy("portion")).applyInArrow(neighbours_joined, PAIRS))
        let_go(relation)
        relation = longer
        maps, groups = frequent_pairs(relation, least)
        found.append(groups)
    let_go(relation)
    return totals, found


def candidates(found: list[DataFrame]) -> DataFrame:
    """lang, words, a, l, r of all frequent phrases of two words or more that no longer one absorbs: its counts of first
    parts `pre` and of last parts `suf`, by length."""
    own = found[0].select("gid", "lang", F.array("word").alias("words"), "a", F.array("a").alias("pre"), F.array("a").alias("suf"))
    out = []
    for groups in found[1:]:
        own = cut_lineage(own)
        left, right = (own.select(*(F.col(c).alias(f"{side}_{c}") for c in ("gid", "lang", "words", "a", "pre", "suf"))) for side in ("l", "r"))
        both = groups.join(left, F.col("left") == F.col("l_gid")).join(right, F.col("right") == F.col("r_gid"))
        longer = cut_lineage(both.select(
            "gid", F.col("l_lang").alias("lang"), F.concat("l_words", F.slice("r_words", -1, 1)).alias("words"), "a", F.concat("l_pre", F.array("a")).alias("pre"), F.concat("r_suf", F.array("a")).alias("suf"),
            F.filter(F.array(F.when(F.col("l_a") == F.col("a"), F.col("l_gid")), F.when(F.col("r_a") == F.col("a"), F.col("r_gid"))), lambda g: g.isNotNull()).alias("absorbs"),
        ))
        if out:
            out[-1] = out[-1].join(longer.select(F.explode("absorbs").alias("gid")).distinct(), "gid", "left_anti")
        own = longer.drop("absorbs")
        out.append(own)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def lowest_cut() -> Column:
    """score, cut, l, r of the cut with the lowest floor(1000 a n / (l r)), the first of equal ones, in exact decimals."""
    wide = "cast({} as decimal(19, 0))".format
    l, r = "pre[i - 1]", "suf[size(words) - i - 1]"
    score = f"({wide('1000 * a')} * {wide('n')}) div ({wide(l)} * {wide(r)})"
    return F.array_min(F.expr(f"transform(sequence(1, size(words) - 1), i -> named_struct('score', {score}, 'cut', i, 'l', {l}, 'r', {r}))"))


def collocations(documents: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, portion: int = PORTION) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to `longest` words by score, a
    (both descending) and phrase, among those with a count of `least` or more that no longer phrase has as often."""
    totals, found = relations(documents, least, longest, portion)
    scored = candidates(found).join(totals, "lang").withColumn("best", lowest_cut())
    rows = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    some = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
