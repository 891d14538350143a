"""Merkle manifest of a dataset: leaves by row, subroots by group, one root, and a proof for each row.

Leaves are ranked within their group, and the rank's digits (base `FAN`) are grouped away one after another within blocks
of FAN ** DIGITS leaves: each step nests the structs of up to FAN children under their parent.  Blocks are ranked nodes
again, and so on until a group has one node.  A last transform and explode walk down the nested structs and give every
leaf its path, without a join within blocks; the path above a block comes by one join of rows that are blocks.

Defined results: a null value is `-`, other ones are their UTF-8 byte count, `:` and the value; a null group is one group,
the first; rows of one doc_id in a group are ordered by their leaves, and rows that repeat all values are leaves of their
own; a null doc_id comes first and is never tampered with; an empty table gives no rows; a group of one leaf has that
leaf as subroot; other columns aren't read; very long texts are hashed whole where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage

FAN, DIGITS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def h(x: Column) -> Column:
    """Lowercase hex SHA-256 of a string's bytes."""
    return F.sha2(F.encode(x, "UTF-8"), 256)


def leaf(row: dict[str, Column]) -> Column:
    """The hash of a row's values, each with its length in front, in the order of FIELDS."""
    framed = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return h(F.concat(*(framed(row[c].cast("string")) for c in FIELDS)))


def lowered(text: Column) -> Column:
    """The tampering of the check: A-Z become lower case."""
    return F.translate(text, UPPER, LOWER)


def is_tampered() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))


def leaves(documents: DataFrame, tampered: Column | None = None, tamper=lowered) -> DataFrame:
    """g (the group as a string that is never null and sorts as lang does, null first), doc_id, hash and seen: the leaf
    of the text as it is found later, which differs where `tampered` holds and tampering changes the text."""
    row = {c: F.col(c) for c in FIELDS}
    own = leaf(row)
    seen = own if tampered is None else F.when(tampered, leaf(row | {"text": tamper(F.col("text"))})).otherwise(own)
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return documents.select(group.alias("g"), "doc_id", own.alias("hash"), seen.alias("seen"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with rank (from 0) and n (rows) within g.  Rows are dealt by ranges of g and the order, so no task holds a
    group; the counts of the ranges, a row for each range and group, give every range its first rank."""
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("here").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("g", "part", "first", before.alias("before"), F.sum("here").over(W.partitionBy("g")).alias("n"))
    return dealt.join(offsets, ["g", "part"]).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("rank"), "n")


def nested(nodes: DataFrame) -> DataFrame:
    """A row for each block of FAN ** DIGITS nodes: g, n (nodes of the group), block, hash and kids, structs in structs.
    nodes: g, n, rank, hash and kids, which stays below the node.  Blocks are dealt once, and all digits are grouped away
    where they were dealt to.  Levels that a group of n nodes doesn't have pass their only hash on."""
    digit = {k: (F.floor(F.col("rank") / F.lit(FAN**k)) % FAN).cast("int").alias(f"d{k}") for k in range(DIGITS)}
    df = nodes.select("g", "n", F.floor(F.col("rank") / F.lit(FAN**DIGITS)).alias("block"), *digit.values(), "hash", "kids").repartition("g", "block")
    for k in range(DIGITS):
        left = [f"d{j}" for j in range(k + 1, DIGITS)]
        df = df.groupBy("g", "n", "block", *left).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "hash", "kids"))).alias("kids"))
        both = h(F.array_join(F.col("kids.hash"), ""))
        df = df.withColumn("hash", F.when(F.col("n") > FAN**k, both).otherwise(F.col("kids")[0]["hash"]))
    return df


def paths(blocks: DataFrame, *carried: str) -> DataFrame:
    """From blocks with `path` (the steps above the block, array of left and right) a row for each node: g, block, rank,
    hash, kids, path from the node's own level up, and the carried columns.  left and right are the siblings' hashes."""
    df = blocks.withColumn("rank", F.col("block"))
    for k in reversed(range(DIGITS)):
        hashes = F.col("kids.hash")
        step = lambda i: F.struct(F.array_join(F.slice(hashes, 1, i), "").alias("left"), F.array_join(F.slice(hashes, i + 2, FAN), "").alias("right"))
        each = F.transform("kids", lambda x, i: F.struct(x["d"].alias("d"), step(i).alias("step"), x["hash"].alias("_hash"), x["kids"].alias("_kids")))
        df = df.select("g", "n", "block", "rank", "path", *carried, F.inline(each))
        path = F.when(F.col("n") > FAN**k, F.concat(F.array("step"), "path")).otherwise(F.col("path"))
        df = df.select("g", "n", "block", (F.col("rank") * FAN + F.col("d")).alias("rank"), F.col("_hash").alias("hash"), F.col("_kids").alias("kids"), path.alias("path"), *carried)
    return df


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the nodes up, until every group has one block, and the last one's g and hash: one node each."""
    tiers = []
    while True:
        tiers.append(cut_lineage(nested(nodes)))
        most = tiers[-1].agg(F.max("n")).first()[0] or 0
        if most <= FAN**DIGITS:
            return tiers, tiers[-1].select("g", "hash")
        nodes = tiers[-1].select("g", F.ceil(F.col("n") / F.lit(FAN**DIGITS)).alias("n"), F.col("block").alias("rank"), "hash", F.lit(None).cast("int").alias("kids"))


NO_STEPS = "array<struct<left:string,right:string>>"


def descended(tiers: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """Nodes of the lowest tier with their paths.  tops: g, path and the carried columns, which hold for the whole group."""
    above, key = tops, ["g"]
    for blocks in reversed(tiers):
        found = paths(blocks.drop("hash").join(above, key), *carried)
        above, key = found.select("g", F.col("rank").alias("block"), "path", *carried), ["g", "block"]
    return found


def manifest(documents: DataFrame, tampered: Column | None = None, tamper=lowered) -> DataFrame:
    """A row for each document: doc_id, leaf, subroot, root, path (from the leaf up: left and right siblings), proof_sha256,
    folded_root (from the leaf as it is found later and the path) and verified."""
    own = cut_lineage(leaves(documents, tampered, tamper).withColumn("copy", F.monotonically_increasing_id()))  # splits rows that repeat
    rows = ranked(own, "doc_id", "hash", "copy")
    tiers, subroots = climbed(rows.select("g", "n", "rank", "hash", F.struct("doc_id", "seen").alias("kids")))
    groups = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "hash"), "group")
    upper, root = climbed(groups.select("g", "n", "rank", "hash", F.struct("group").alias("kids")))
    start = root.select("g", F.array().cast(NO_STEPS).alias("path"), F.col("hash").alias("root"))
    tops = descended(upper, start, "root").select(F.col("kids.group").alias("g"), "path", F.col("hash").alias("subroot"), "root")
    found = descended(tiers, tops, "subroot", "root")
    proof = h(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    folded = F.aggregate("path", F.col("kids.seen"), lambda node, s: h(F.concat(s["left"], node, s["right"])))
    out = found.select(F.col("kids.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", "path", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
