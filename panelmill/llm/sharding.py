"""Minimum-cost-flow resharding.

Given each document's old shard and the number of new shards, the new capacities are level in bytes.  A minimum-cost
flow from old shard sizes to new capacities, where staying costs nothing and moving costs its bytes, gives the bytes
that each old shard sends to each new one.  The flows are then cut out of each old shard as contiguous blocks of an
order in which the largest documents come first, so that block edges fall between small documents.  Only shards that
send or receive anything need a rewrite.

The driver sees totals for (old shard, size class, salt) cells, whose number is bounded by parameters, and the few
documents larger than a 64th of a new shard, fewer than 64 x shards.  Those can't be cut around: in order of size each
goes where the flow of all bytes has room for it (staying comes first), and a second flow, of the other documents to what
the capacities have left, levels the rest.  Cumulative sums run within cells, so no task holds a whole shard, however full
it is.

Defined results: a null text has size 1; a null old shard is shard 0; repeated rows are placed one by one;
an empty table gives an empty result; a null key is a key like others; other columns aren't read.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage


@dataclass(frozen=True)
class Plan:
    """sends[i][j]: bytes that old shard i gives to new shard j; giants: where documents too large to cut around go."""

    sends: list[list[int]]
    giants: dict[tuple, int]
    threshold: int


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from i to j at the least total cost; cost 0 for i = j and 1 for a byte elsewhere.  Successive shortest
    paths with 0-1 costs; sums must be equal."""
    n, m = len(supply), len(capacity)
    source, sink, size = n + m, n + m + 1, n + m + 2
    room = [[0] * size for _ in range(size)]
    cost = [[0] * size for _ in range(size)]
    for i, s in enumerate(supply):
        room[source][i] = s
        for j in range(m):
            room[i][n + j] = s
            cost[i][n + j], cost[n + j][i] = int(i != j), -int(i != j)
    for j, c in enumerate(capacity):
        room[n + j][sink] = c
    while True:
        far, via, queue, waiting = [float("inf")] * size, [-1] * size, deque([source]), [False] * size
        far[source] = 0
        while queue:
            u = queue.popleft()
            waiting[u] = False
            for v in range(size):
                if room[u][v] > 0 and far[u] + cost[u][v] < far[v]:
                    far[v], via[v] = far[u] + cost[u][v], u
                    if not waiting[v]:
                        waiting[v] = True
                        queue.append(v)
        if via[sink] < 0:
            return [[room[n + j][i] for j in range(m)] for i in range(n)]
        v, push = sink, float("inf")
        while v != source:
            push, v = min(push, room[via[v]][v]), via[v]
        v = sink
        while v != source:
            room[via[v]][v] -= push
            room[v][via[v]] += push
            v = via[v]


def level(fixed: list[int], total: int) -> list[int]:
    """What each shard takes beyond `fixed` so that `total` more bytes make them as even as can be."""
    take, order, left = [0] * len(fixed), sorted(range(len(fixed)), key=lambda j: (fixed[j], j)), total
    for k in range(len(order), 0, -1):
        lowest = order[:k]
        if (height := (left + sum(fixed[j] for j in lowest)) // k) >= fixed[lowest[-1]]:
            for j in lowest:
                take[j] = height - fixed[j]
            for j in lowest[: left - sum(take)]:
                take[j] += 1
            break
    return take


def sized(documents: DataFrame, old_shard, key: str = "doc_id", text: str = "text", salts: int = 32) -> DataFrame:
    """Adds size, text_crc32, old_shard and the cell of the block order: size class (largest first) and salt."""
    body = F.coalesce(F.col(text), F.lit(""))
    return (
        documents.withColumns({"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(F.encode(body, "UTF-8")), "old_shard": old_shard.cast("int")})
        .withColumn("size_class", -F.floor(F.log2(F.col("size")) * 2).cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(salts)).cast("int"))
    )


CELL = ("old_shard", "size_class", "salt")


def plan_transfers(docs: DataFrame, shards: int, key: str = "doc_id") -> tuple[Plan, list[tuple]]:
    """docs: from sized().  Totals go through the driver; see the module's notes on their bound."""
    cells = sorted(tuple(r) for r in docs.groupBy(*CELL).agg(F.sum("size"), F.count(F.lit(1))).collect())
    total = sum(c[3] for c in cells)
    threshold = max(total // (64 * shards), 1024)
    big = docs.where(F.col("size") > threshold).groupBy("size", "text_crc32", key, "old_shard").count().collect() if any(2 ** (-c[1] / 2 + 0.5) > threshold for c in cells) else []
    olds = max([shards, *(c[0] + 1 for c in cells)])
    supply = [0] * olds
    for c in cells:
        supply[c[0]] += c[3]
    room, free = min_cost_flow(supply, level([0] * shards, total)), level([0] * shards, total)
    load, giants = [0] * shards, {}
    for size, crc, doc, old, n in sorted(big, key=lambda r: (-r[0], r[1], str(r[2]), r[3])):
        for copy in range(n):
            has = [min(room[old][k], free[k]) for k in range(shards)]
            j = old if old < shards and has[old] >= size / 2 else max(range(shards), key=lambda k: (has[k], -k))
            room[old][j] -= size
            free[j] -= size
            load[j] += size
            giants[size, crc, doc, old, copy] = j
    for size, _, _, old, _ in giants:
        supply[old] -= size
    return Plan(min_cost_flow(supply, level(load, sum(supply))), giants, threshold), cells


def reshard(documents: DataFrame, old_shard, shards: int = 16, key: str = "doc_id", text: str = "text", salts: int = 32, keep: bool = False) -> DataFrame:
    """key, size, text_crc32, old_shard, shard int and slot long (gapless from 0 in a shard) of every row; with keep all
    columns of documents other than shard and slot too, under `row`."""
    spark = documents.sparkSession
    columns = [F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard")]
    whole = sized(documents.select(*columns, *([F.struct(*(c for c in documents.columns if c not in ("shard", "slot"))).alias("row")] if keep else [])), F.col("old_shard"), "key", "text", salts).drop("text")
    docs = cut_lineage(whole.drop("row"))  # texts are measured once
    out = _placed(spark, whole if keep else docs, docs, shards)
    return out.select(F.col("key").alias(key), "size", "text_crc32", "old_shard", "shard", "slot", *(["row"] if keep else []))


def _placed(spark: SparkSession, rows: DataFrame, docs: DataFrame, shards: int, key: str = "key") -> DataFrame:
    """rows with shard and slot.  docs: the same rows without their contents, from which totals are taken."""
    plan, _ = plan_transfers(docs, shards, key)
    own = W.partitionBy(*CELL).orderBy(F.col("size").desc(), F.col(key), "text_crc32")
    fixed = [(*k, j) for k, j in plan.giants.items()]
    schema = f"size long, text_crc32 long, `{key}` {docs.schema[key].dataType.simpleString()}, old_shard int, copy int, giant int"
    giants = F.broadcast(spark.createDataFrame(fixed, schema))  # fewer than 64 x shards
    small = F.col("size") <= plan.threshold
    starts, at = [], {}
    for old, size_class, salt, n in sorted(tuple(r) for r in docs.where(small).groupBy(*CELL).agg(F.sum("size").alias("bytes")).collect()):
        starts.append((old, size_class, salt, at.get(old, 0)))
        at[old] = at.get(old, 0) + n
    offsets = spark.createDataFrame(starts, "old_shard int, size_class int, salt int, start long")
    cuts = []
    for old, sends in enumerate(plan.sends):
        edge = 0
        for j in sorted(range(shards), key=lambda j: (j != old, j)):  # what stays comes first: the largest documents
            if sends[j]:
                cuts.append((old, edge, edge + sends[j], j))
                edge += sends[j]
    blocks = spark.createDataFrame(cuts, "old_shard int, lo long, hi long, shard int")

    def with_shard(df: DataFrame) -> DataFrame:
        big = df.where(~small).withColumn("copy", F.row_number().over(W.partitionBy("size", "text_crc32", key, "old_shard").orderBy("salt")) - 1)
        on = [big[c].eqNullSafe(giants[c]) for c in ("size", "text_crc32", key, "old_shard", "copy")]
        big = big.join(giants, on).select(*(big[c] for c in df.columns), F.col("giant").alias("shard"))
        inside = df.where(small).withColumn("before", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, -1)))
        inside = inside.join(F.broadcast(offsets), list(CELL)).withColumn("middle", F.col("start") + F.coalesce("before", F.lit(0)) + F.col("size") / 2)
        held = (inside["old_shard"] == blocks["old_shard"]) & (F.col("middle") >= F.col("lo")) & (F.col("middle") < F.col("hi"))
        return inside.join(F.broadcast(blocks), held).select(*(inside[c] for c in df.columns), "shard").unionByName(big)

    in_cell = W.partitionBy(*CELL, "shard").orderBy(F.col("size").desc(), F.col(key), "text_crc32")
    ranks, full = [], {}
    for shard, old, size_class, salt, n in sorted(tuple(r) for r in with_shard(docs).groupBy("shard", *CELL).count().collect()):
        ranks.append((shard, old, size_class, salt, full.get(shard, 0)))
        full[shard] = full.get(shard, 0) + n
    first = F.broadcast(spark.createDataFrame(ranks, "shard int, old_shard int, size_class int, salt int, first long"))
    return with_shard(rows).withColumn("nth", F.row_number().over(in_cell)).join(first, ["shard", *CELL]).withColumn("slot", F.col("first") + F.col("nth") - 1)


def affected(placed: DataFrame) -> list[int]:
    """New shards whose files change: those that lose or receive a document.  One row for each shard at most."""
    moved = placed.where(F.col("old_shard") != F.col("shard"))
    return sorted(r[0] for r in moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect())


def rewrite(documents: DataFrame, old_shard, path: str, shards: int = 16, key: str = "doc_id", text: str = "text") -> list[int]:
    """Reshards and writes all columns and slot of the affected shards as Parquet folders shard=N under path, each row once.
    Other folders stay as they are; those of affected shards that have no row any more are removed.  A column of
    documents that is named shard or slot is replaced."""
    placed = reshard(documents, old_shard, shards, key, text, keep=True)
    changed = affected(placed.drop("row"))
    out = placed.where(F.col("shard").isin(changed)).select("row.*", "shard", "slot", F.pmod(F.xxhash64("slot"), F.lit(8)).alias("_part"))
    out.repartition("shard", "_part").drop("_part").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    context = documents.sparkSession.sparkContext
    filled = {r[0] for r in placed.select("shard").distinct().collect()}
    for shard in set(changed) - filled:
        at = context._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    return changed
