"""Per-symbol Parquet datasets: scans with pushdown, joins that align them in time, and writes that append or update."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.durations import multiply_duration, shift_datetime
from .files import ReadError, listing, read_symbols

#: Discrete tables are read from so many days before the range, so that their last earlier row is there.
LOOK_BACK_DAYS = 150


@dataclass(frozen=True)
class Catalog:
    """Folders below `main_dir`, and the columns to take of each.  A folder holds one {symbol}.parquet for each symbol, or
    one Parquet dataset; an error names what is absent or broken (see `files.py`)."""

    main_dir: str
    base: dict[str, list[str]]
    continuous: dict[str, list[str]] = field(default_factory=dict)
    discrete: dict[str, list[str]] = field(default_factory=dict)
    date: str = "datetime"
    symbol: str = "symbol"


def scan(spark: SparkSession, path: str, columns: list[str], date: str = "datetime", symbol: str | None = None, symbols: list[str] | None = None, begin=None, end=None) -> DataFrame:
    """Projection and range reach the Parquet scan; symbols are files where there is one for each, and a filter else."""
    df = spark.read.parquet(path).select(*columns)
    if begin is not None:
        df = df.where(F.col(date) >= F.lit(begin).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("timestamp_ntz"))
    if symbols is not None and symbol:
        df = df.where(F.col(symbol).isin(symbols))
    return df.withColumn(date, F.col(date).cast("timestamp_ntz"))


def start_of(kind: str, begin: dt.datetime, shift_n: int = 0, freq: str = "1d") -> dt.datetime:
    """Where a table of this kind is read from: base at begin, discrete 150 days before, continuous 20 * shift * freq."""
    if kind == "discrete":
        return begin - dt.timedelta(days=LOOK_BACK_DAYS)
    return shift_datetime(begin, multiply_duration(20 * shift_n, freq)) if kind == "continuous" and shift_n else begin


def shift_dates(df: DataFrame, n: int, date: str, symbol: str) -> DataFrame:
    """Row t's values become usable at the date of the symbol's row t + n; the last n rows go."""
    if not n:
        return df
    return df.withColumn(date, F.lead(date, n).over(W.partitionBy(symbol).orderBy(date))).where(F.col(date).isNotNull())


def join_continuous(base: DataFrame, other: DataFrame, date: str, symbol: str, shift_n: int = 0) -> DataFrame:
    return base.join(shift_dates(other, shift_n, date, symbol), [date, symbol], "left")


def join_discrete(tables: list[DataFrame]) -> DataFrame:
    """Full outer join on all columns that two tables share, after removing duplicates."""
    out = tables[0].dropDuplicates()
    for df in tables[1:]:
        common = [c for c in out.columns if c in df.columns]
        if not common:
            raise ValueError("discrete tables have no common column")
        out = out.join(df.dropDuplicates(), common, "full")
    return out


def as_of(left: DataFrame, right: DataFrame, date: str, symbol: str) -> DataFrame:
    """All left rows with the right columns of the symbol's last row at or before the date.  One sort-based window over
    both sides; nulls of the matched row stay null; of equal dates the largest row counts."""
    values = [c for c in right.columns if c not in (date, symbol)]
    kept = [c for c in left.columns if c not in (date, symbol)]
    r = right.dropDuplicates().select(date, symbol, F.lit(0).alias("_side"), F.struct(*values).alias("_r"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept))
    none = F.lit(None).cast(r.schema["_r"].dataType)
    both = r.unionByName(left.select(date, symbol, F.lit(1).alias("_side"), none.alias("_r"), *kept))
    order = W.partitionBy(symbol).orderBy(date, "_side", F.col("_r").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_last", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    return both.select(*left.columns, *(F.col("_last")[c].alias(c) for c in values))


def load(spark: SparkSession, catalog: Catalog, begin=None, end=None, symbols: list[str] | None = None, shift_n: int = 0, freq: str = "1d", drop_nulls: bool = False) -> DataFrame:
    """Base table, continuous tables joined on equal (shifted) dates, discrete tables as of each date."""
    c = catalog

    def read(name: str, columns: list[str], kind: str) -> DataFrame:
        since = start_of(kind, begin, shift_n, freq) if begin is not None else None
        if not columns:
            raise ReadError(f"no columns are named for {name!r}")
        if listing(spark, f"{c.main_dir}/{name}"):
            return read_symbols(spark, f"{c.main_dir}/{name}", columns, c.date, c.symbol, symbols, since, end)[0]
        return scan(spark, f"{c.main_dir}/{name}", list(dict.fromkeys([c.date, c.symbol, *columns])), c.date, c.symbol, symbols, since, end)

    (base_name, base_columns), *more = c.base.items()
    if more:
        raise ValueError("there is one base table")
    out = read(base_name, base_columns, "base")
    for name, columns in c.continuous.items():
        out = join_continuous(out, read(name, columns, "continuous"), c.date, c.symbol, shift_n)
    if c.discrete:
        out = as_of(out, join_discrete([read(n, cols, "discrete") for n, cols in c.discrete.items()]), c.date, c.symbol)
    return out.dropna() if drop_nulls else out


def appended(old: DataFrame, new: DataFrame, date: str, symbol: str) -> DataFrame:
    """Old rows and those new ones whose date the symbol doesn't have; columns that one side lacks are null there."""
    fresh = new.join(old.select(date, symbol).distinct(), [date, symbol], "left_anti")
    both = old.unionByName(fresh, allowMissingColumns=True)
    return both.select(*old.columns, *(c for c in new.columns if c not in old.columns))


def updated(old: DataFrame, new: DataFrame, date: str, symbol: str) -> DataFrame:
    """Old rows, with values of the new ones where dates overlap and the new value isn't null; nothing is inserted."""
    values = [c for c in new.columns if c not in (date, symbol)]
    new = new.select(date, symbol, *(F.col(c).alias(f"_{c}") for c in values))
    joined = old.join(new, [date, symbol], "left")
    fresh = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in old.columns else F.col(f"_{c}")
    return joined.select(*(fresh(c).alias(c) if c in values else F.col(c) for c in old.columns), *(fresh(c).alias(c) for c in values if c not in old.columns))


def save(spark: SparkSession, df: DataFrame, path: str, factors: list[str], date: str = "datetime", symbol: str = "symbol", append: bool = False) -> None:
    """Writes date and factors, a folder for each symbol.  A dataset that is there gets new dates (append) or new values
    on the dates it has; only folders of symbols in `df` are rewritten."""
    new = df.select(date, symbol, *factors)
    staged = f"{path}.new"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        old = spark.read.parquet(path).withColumn(symbol, F.col(symbol).cast(df.schema[symbol].dataType))
        old = old.join(new.select(symbol).distinct(), symbol, "left_semi")
        new = (appended if append else updated)(old, new, date, symbol)
    new.repartition(symbol).sortWithinPartitions(symbol, date).write.mode("overwrite").partitionBy(symbol).parquet(staged)
    spark.read.parquet(staged).withColumn(symbol, F.col(symbol).cast(df.schema[symbol].dataType)).repartition(symbol).sortWithinPartitions(symbol, date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(symbol).parquet(path)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
