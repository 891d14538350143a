"""Places in an order of all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut_lineage


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with their place from 0 in the order of a column.  Rows are dealt by ranges and sorted there; the counts of
    the ranges, a row for each, give every range its first place."""
    dealt = df.repartitionByRange(column).sortWithinPartitions(column)
    dealt = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    ranges = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(ranges.select("_part", "_first", before.alias("_before")), "_part").select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
