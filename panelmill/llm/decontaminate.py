"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Training words become postings (term, document, position).  Every benchmark window of `window` words is looked up by
the rarest of its terms; only postings of such terms are stored, each with its neighbourhood of words, which is the
list of the other terms at positions adjusted by their offsets.  Intersecting a window's lists from the rarest term on
therefore is a local comparison, and no posting of a frequent word is ever shuffled.  The same lookup gives phrases (the
window's words at their offsets) and proximity matches (all its distinct words near its rarest one, in any order).

A window that many items share is looked up and verified once; its items are joined to the sets of windows that documents
turn out to hold.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.  Defined results: null and empty texts
have no words and no hits; an item of fewer words than a window, but not none, is one window; repeated rows give
repeated rows, and repeated items are one each for their own item_id; no benchmark rows give no hits; very long texts
are handled whole; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, small_enough

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Rows of benchmark terms or anchors that are broadcast at most; beyond it Spark shuffles.
BROADCAST_ROWS = 200_000
#: Windows with one rarest term that are compared in one row.
WINDOWS_A_ROW = 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, -1), lambda w: w != "")


def frequencies(documents: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """term, df: how often each of the terms stands in the corpus."""
    return documents.select(F.explode(words_of(F.col("text"))).alias("term")).join(small_enough(terms, n_terms, BROADCAST_ROWS), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def postings(documents: DataFrame, terms: DataFrame, n_terms: int, reach: int) -> DataFrame:
    """The index of the given terms: term, doc_id, text_key, pos (from 0), first (position of the neighbourhood's first
    word) and near (words from pos - reach to pos + reach), where one of the term's `mates` is near.  text_key tells apart
    rows of one doc_id."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    every = docs.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "term")).join(small_enough(terms, n_terms, BROADCAST_ROWS), "term")
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    cut = every.select("term", "doc_id", "text_key", "pos", "mates", first.alias("first"), F.slice("words", first + 1, F.lit(2 * reach + 1)).alias("near"))
    return cut.where(F.arrays_overlap("mates", "near")).drop("mates")


def benchmark_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (win, words), and win and item_id of all items that have them."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    each = items.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start") + 1, F.lit(window)).alias("words")).distinct()
    windows = cut_lineage(each.select("words").distinct().withColumn("win", F.monotonically_increasing_id()))
    return windows, cut_lineage(each.join(windows, "words").select("win", "item_id"))


def lookups(documents: DataFrame, windows: DataFrame, within: int) -> DataFrame:
    """Postings joined with the windows that they are the rarest term of: doc_id, text_key, pos, here (place of pos in
    near), near (words up to `within` words away) and ws, WINDOWS_A_ROW windows at most, with win, offset (of the rarest
    term), words and others (the distinct words but the rarest, in order of frequency).  How many items share a window
    doesn't matter here."""
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    n_terms = vocabulary.count()
    df = small_enough(frequencies(documents, vocabulary, n_terms), n_terms, BROADCAST_ROWS)
    each = windows.select("win", "words", F.posexplode("words").alias("offset", "term")).join(df, "term", "left")
    by_df = F.array_sort(F.collect_list(F.struct("df", "offset", "term"))).alias("by_df")
    rarest = each.groupBy("win").agg(by_df, F.first("words").alias("words")).where(F.forall("by_df", lambda t: t["df"].isNotNull()))  # else a word that no document has
    r = F.col("by_df")[0]
    others = F.array_remove(F.array_distinct(F.col("by_df.term")), r["term"])
    rarest = rarest.select(r["term"].alias("term"), F.struct("win", r["offset"].alias("offset"), F.col("words"), others.alias("others")).alias("w"))
    share = W.partitionBy("term").orderBy("w.win")
    rarest = rarest.withColumn("row", F.floor((F.row_number().over(share) - 1) / WINDOWS_A_ROW))
    anchors = cut_lineage(rarest.groupBy("term", "row").agg(F.collect_list("w").alias("ws")))  # small, used three times
    mate = F.explode(F.transform("ws", lambda w: F.coalesce(F.get(w["others"], F.lit(0)), F.col("term"))))  # the second rarest, if there is one
    terms = cut_lineage(anchors.select("term", mate.alias("mate")).groupBy("term").agg(F.collect_set("mate").alias("mates")))
    index = postings(documents, terms, terms.count(), within)
    pairs = index.join(small_enough(anchors, windows.count(), BROADCAST_ROWS), "term")
    return pairs.select("doc_id", "text_key", "pos", (F.col("pos") - F.col("first")).alias("here"), "near", "ws")


def _fits() -> Column:
    """The windows of a lookup whose words stand at their offsets."""
    at = lambda w: F.slice(F.col("near"), F.greatest(F.col("here") - w["offset"], F.lit(0)) + 1, F.size(w["words"]))
    return F.filter("ws", lambda w: (w["offset"] <= F.col("here")) & (at(w) == w["words"]))


def _near_ones() -> Column:
    """The windows of a lookup all of whose words are near."""
    return F.transform(F.filter("ws", lambda w: F.forall(w["others"], lambda x: F.array_contains(F.col("near"), x))), lambda w: w["win"])


def _phrases(found: DataFrame) -> DataFrame:
    """start and end of what the windows of a posting cover together, and wins."""
    return found.where(F.size("fits") > 0).select(
        "doc_id", "text_key",
        (F.col("pos") - F.array_max(F.transform("fits", lambda w: w["offset"]))).alias("start"),
        (F.col("pos") + F.array_max(F.transform("fits", lambda w: F.size(w["words"]) - w["offset"]))).alias("end"),
        F.col("fits.win").alias("wins"),
    )


def phrase_matches(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Exact matches: doc_id, text_key, item_id, start, end (word positions, end exclusive) of each window."""
    windows, items = benchmark_windows(benchmark, window)
    found = lookups(documents, windows, window - 1).withColumn("fits", _fits()).select("doc_id", "text_key", "pos", F.explode("fits").alias("w"))
    start = F.col("pos") - F.col("w.offset")
    each = found.select("doc_id", "text_key", F.col("w.win").alias("win"), start.alias("start"), (start + F.size("w.words")).alias("end"))
    return each.join(items, "win").drop("win").distinct()


def proximity_matches(documents: DataFrame, benchmark: DataFrame, window: int = 10, within: int = 30) -> DataFrame:
    """Windows all of whose distinct words stand within `within` words (window - 1 at least, so that phrases are among
    them) of an occurrence of their rarest one, in any order: doc_id, text_key, item_id, pos (of the rarest one).  Items
    of any length are looked for, window by window; of equally rare words the first one of the window counts."""
    windows, items = benchmark_windows(benchmark, window)
    near = lookups(documents, windows, max(within, window - 1)).select("doc_id", "text_key", "pos", F.explode(_near_ones()).alias("win"))
    return near.join(items, "win").drop("win").distinct()


def item_sets(sets: DataFrame, items: DataFrame) -> DataFrame:
    """wins (sorted windows), and n and sha256 of the items that have one of them.  Documents share sets, so the items of a
    window that stands in many documents and items are looked up once for each set, not for each document."""
    each = sets.distinct().select("wins", F.explode("wins").alias("win")).join(items, "win").select("wins", F.col("item_id").cast("string").alias("item")).distinct()
    names = F.array_sort(F.collect_list("item"))
    return each.groupBy("wins").agg(F.count("item").alias("n"), F.sha2(F.encode(F.array_join(names, ","), "UTF-8"), 256).alias("sha256"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, within: int | None = None) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and text_key.  With `within`
    also n_near_items, the items with proximity matches; these make no document contaminated."""
    windows, items = benchmark_windows(benchmark, window)
    reach = window - 1 if within is None else max(within, window - 1)
    found = lookups(documents, windows, reach).select("doc_id", "text_key", "pos", _fits().alias("fits"), (_near_ones() if within is not None else F.array().cast("array<bigint>")).alias("near"))
    found = cut_lineage(found.where((F.size("fits") > 0) | (F.size("near") > 0)))
    matches = _phrases(found)
    by_start = W.partitionBy("doc_id", "text_key").orderBy("start", "end")
    before = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    runs = matches.groupBy("doc_id", "text_key", "start", "end").agg(F.array_distinct(F.flatten(F.collect_set("wins"))).alias("wins"))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    fresh = F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0))
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    hits = runs.groupBy("doc_id", "text_key").agg(F.sum(fresh).alias("n_hit"), together("wins").alias("wins"))
    close = found.where(F.size("near") > 0).groupBy("doc_id", "text_key").agg(together("near").alias("near"))
    both = hits.unionByName(close, allowMissingColumns=True).groupBy("doc_id", "text_key")
    hits = cut_lineage(both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n_hit", "wins", "near"))))
    known = cut_lineage(item_sets(hits.select("wins").unionByName(hits.select(F.col("near").alias("wins"))).where(F.col("wins").isNotNull()), items))
    named = lambda c, n, *more: known.select(F.col("wins").alias(c), F.col("n").alias(n), *more)
    hits = hits.join(named("wins", "n_items", F.col("sha256")), "wins", "left").join(named("near", "n_near_items"), "near", "left")
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]) & (docs["text_key"] == hits["text_key"]), "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    near = [] if within is None else [whole("n_near_items").alias("n_near_items")]
    none = F.sha2(F.encode(F.lit(""), "UTF-8"), 256)
    return joined.select(docs["doc_id"], docs["text_key"], "n_words", whole("n_hit").alias("n_hit"), whole("n_items").alias("n_items"), F.coalesce("sha256", none).alias("items_sha256"), (whole("n_hit") > 0).alias("contaminated"), *near)
