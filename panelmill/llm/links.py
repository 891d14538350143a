"""Verified links from colliding bands, and the components of links.

A band key that holds many ids doesn't give all pairs.  Small keys are paired fully.  In each larger key the id that
collides most often over all keys is the hub, and all others are compared with it; ids that are linked with a hub are in
one component and need no comparison with each other.  What a hub leaves over is compared with all ids that share a key
with that hub, exactly, in blocks inside tasks that are bounded by numbers of shingles: shared shingles are counted
through an index of the block.  A block gives out the links that join its ids into components and no others, so no list of
pairs is made.  So every colliding pair is either linked through its hub or compared.

Set similarities are worked out from 64-bit shingle hashes, which are made once for each id that collides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, let_go

#: About how many shingles each side of a block holds, and how many parts a hub's rows are dealt over.
BLOCK_SHINGLES, SALTS = 200_000, 32


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) for every id of links (a, b), of any type with an order.  Each turn an id takes
    the smallest of its own label, its neighbours' labels and the label of its label; it ends when no label falls."""
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").select(F.col("a").alias("id"), "component", F.lit(None).alias("old"))
        root = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        root = labels.join(root, "component").select("id", F.col("root").alias("component"), F.lit(None).alias("old"))
        every = labels.select("id", "component", F.col("component").alias("old")).unionByName(near).unionByName(root)
        new = cut_lineage(every.groupBy("id").agg(F.min("component").alias("component"), F.min("old").alias("old")))
        let_go(labels)
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            let_go(edges)
            return labels


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity: exact Jaccard of the shingle sets of a and b.  sets: id, shingles (ascending 64-bit numbers)."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(p, q)
                both = int((p[np.minimum(at, len(p) - 1)] == q).sum()) if len(p) else 0
                out.append(both / max(len(p) + len(q) - both, 1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def near_links(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float = 0.8, small: int = 8) -> tuple[DataFrame, DataFrame]:
    """members: key, id, size (number of distinct shingles).  sets_of: from distinct ids to id and shingles.  Returns
    links (a, b, similarity) and components (id, component); both hold every id that has a link."""
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut_lineage(members.join(counts, "key"))
    few = members.where(F.col("n") <= small)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.size").alias("n_a"), F.col("b.size").alias("n_b"))
    degrees = members.groupBy("id").agg(F.sum("n").alias("degree"))
    large = members.where(F.col("n") > small)
    hubs = large.join(degrees, "id").groupBy("key").agg(F.max(F.struct("degree", "id", "size")).alias("hub"))
    star = large.join(hubs, "key").where(F.col("id") != F.col("hub.id")).select(F.col("hub.id").alias("hub"), F.col("hub.size").alias("hub_size"), "id", "size")
    star = cut_lineage(star.distinct())
    pairs = pairs.unionByName(star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), F.col("size").alias("n_a"), F.col("hub_size").alias("n_b")))
    alike = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")  # else the similarity can't reach it
    pairs = cut_lineage(pairs.where(alike).select("a", "b").distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(star.select("id")).distinct()
    sets = cut_lineage(sets_of(ids))
    links = cut_lineage(similarities(pairs, sets).where(F.col("similarity") >= threshold))
    let_go(members, pairs)
    more = cut_lineage(_left_over(star, links, sets, threshold))
    links = links.unionByName(more)
    found = components(links)
    let_go(star, sets)
    return links, found


def _dealt(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1).cast("array<int>"))


def _left_over(star: DataFrame, links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity: links of ids that aren't linked with their hub, with all ids that share a key with that hub."""
    kind = star.schema["id"].dataType.simpleString()
    linked = links.select("a", "b", F.lit(True).alias("linked"))
    ends = [F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")]
    own = star.select("hub", "id", "size", *ends).join(linked, ["a", "b"], "left").select("hub", "id", "size", F.isnull("linked").alias("lone"))
    own = cut_lineage(own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
    parts = own.groupBy("hub").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("lone"), F.col("size"))).alias("some")).where("some IS NOT NULL")
    count = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int")
    parts = parts.select("hub", count("some").alias("xs"), count("all").alias("ys"), _dealt(F.lit(SALTS)).alias("salt"))
    own = own.join(parts, ["hub", "salt"]).drop("salt").join(sets, "id")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    x = own.where("lone").select("hub", "id", "shingles", F.lit(True).alias("is_x"), at("xs").alias("bx"), _dealt(F.col("ys")).alias("by"))
    y = own.select("hub", "id", "shingles", F.lit(False).alias("is_x"), at("ys").alias("by"), _dealt(F.col("xs")).alias("bx"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["is_x", "id"])
        side, ids = block["is_x"].to_numpy(), block["id"].tolist()
        sets = [np.frombuffer(s, np.uint64) for s in block["shingles"]]
        return pd.DataFrame(forest(ids, sets, np.flatnonzero(side), np.flatnonzero(~side), threshold), columns=["a", "b", "similarity"])

    return x.unionByName(y).groupBy("hub", "bx", "by").applyInPandas(compare, f"a {kind}, b {kind}, similarity double").distinct()


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of xs how many elements it shares with each set of ys; elements of a set are distinct."""
    flat = np.concatenate(ys)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(ys)), [len(y) for y in ys])[order]
    for x in xs:
        lo = np.searchsorted(flat, x)
        n = np.searchsorted(flat, x, side="right") - lo
        places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.bincount(owner[places], minlength=len(ys))


def forest(ids: list, sets: list[np.ndarray], xs: np.ndarray, ys: np.ndarray, threshold: float) -> list[tuple]:
    """Links between xs and ys (places in ids) that join them into components, one fewer than a component has ids."""
    up: dict = {}

    def root(i):
        while (j := up.get(i, i)) != i:
            up[i] = i = up.get(j, j)
        return i

    out, size = [], np.array([len(s) for s in sets])
    if len(xs) and len(ys):
        for i, both in zip(xs, shared_counts([sets[i] for i in xs], [sets[j] for j in ys])):
            similarity = both / np.maximum(size[i] + size[ys] - both, 1)
            for k in np.flatnonzero(similarity >= threshold):
                p, q = ids[i], ids[ys[k]]
                if (r := root(p)) != (s := root(q)):
                    up[max(r, s)] = min(r, s)
                    out.append((min(p, q), max(p, q), float(similarity[k])))
    return out
