"""Times the headline queries.  BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8); one JSON line.
With BENCH_LARGE also a whole study over about 4 M rows, in a line of its own on the error output."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("OMP_NUM_THREADS", "1")

from panelmill import catalog, queries  # noqa: E402
from panelmill.operators.purify import Purifier  # noqa: E402
from panelmill.panel import Panel  # noqa: E402
from panelmill.plans.config import AnalysisConfig, ResearchConfig  # noqa: E402
from panelmill.study import FactorStudy  # noqa: E402

#: The catalogue's queries that stand for a family each.
HEADLINE = ("x02_mad", "x09_rankgauss", "z06_rolling", "n01_multi_ols", "n07_huber", "f02_bins_forward_return", "f20_ic_series", "e06_portfolio_exposures", "j04_as_of_join")


def chain(spark: SparkSession, d: str) -> DataFrame:
    return Purifier(queries.month_panel(spark, d)).winsorize("mad").neutralize("multiOLS", ["beta", "size"]).standardize("zscore").result()


def study(spark: SparkSession, d: str, part: str) -> DataFrame:
    s = FactorStudy(queries.day_panel(spark, d), ResearchConfig(rebalance_periods=("W", "M", "Q")), AnalysisConfig()).run()
    return {"stats": lambda: s.stats, "returns": lambda: s.returns}[part]()


def large_panel(spark: SparkSession, d: str, folder: str) -> Panel:
    """About 4 M rows of the line items: each one's part on its ship date and six days more, at a price that moves a little."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_shipdate", F.col("l_partkey").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_discount", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    moved = F.col("price") * (1 + (F.pmod(F.xxhash64("symbol", "l_shipdate", "k"), F.lit(200)) - 100) / 5000)
    noise = F.pmod(F.xxhash64("k", "symbol", "l_shipdate"), F.lit(1000)) / 1e5
    panel = rows.groupBy(F.date_add("l_shipdate", F.col("k")).cast("timestamp_ntz").alias("datetime"), "symbol").agg(F.avg(moved).alias("close"), F.avg(F.col("l_discount") + noise).alias("factor"))
    panel.write.mode("overwrite").parquet(folder)
    return Panel(spark.read.parquet(folder))


def large(spark: SparkSession, d: str, own: str) -> dict[str, float]:
    """Seconds of the parts of a whole study over the large panel: long, short and long-short by W, M and Q, and IC."""
    panel, took = large_panel(spark, d, f"{own}/large"), {"rows": 0.0}
    took["rows"] = panel.df.count()
    began = time.perf_counter()
    s = FactorStudy(panel, ResearchConfig(rebalance_periods=("W", "M", "Q")), AnalysisConfig()).run()
    for name in ("stats", "returns", "returns_ls", "turnover", "ic_stats"):
        at = time.perf_counter()
        sink(getattr(s, name))
        took[name] = round(time.perf_counter() - at, 3)
    return took | {"study": round(time.perf_counter() - began, 3)}


def sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    own = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", own).config("spark.checkpoint.dir", f"{own}/checkpoints").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: catalog.QUERIES[name] for name in HEADLINE}
    jobs |= {"chain_mad_ols_zscore": chain, "backtest_WMQ_stats": lambda s, p: study(s, p, "stats"), "backtest_WMQ_returns": lambda s, p: study(s, p, "returns")}
    sink(jobs["x02_mad"](spark, d))  # the first query also pays for the JVM's start
    took = {}
    for name, f in jobs.items():
        began = time.perf_counter()
        sink(f(spark, d))
        took[name] = round(time.perf_counter() - began, 3)
    if os.environ.get("BENCH_LARGE"):
        print(json.dumps({"large": large(spark, d, own)}), file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "sum of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
