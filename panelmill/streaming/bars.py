"""Panel rows from an event stream: one row for each bar and symbol, given out once no late event can change it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_bars(events: DataFrame, length: str = "1 day", late: str = "1 hour", time: str = "ts", symbol: str = "user_id", value: str = "value") -> DataFrame:
    """datetime, symbol, close (mean value), n.  Events later than `late` behind the newest one are left out, and state
    of closed bars is dropped.  Works on a streaming frame (append mode) and on a batch."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", late)
    bars = rows.groupBy(F.window("_t", length), F.col(symbol).alias("symbol")).agg(F.avg(value).alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select(F.col("window.start").cast("timestamp_ntz").alias("datetime"), "symbol", "close", "n")
