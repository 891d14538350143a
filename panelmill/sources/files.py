"""Tables that are many files, one for each symbol: which ones there are, which ones can't be read, and their union."""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ReadError(RuntimeError):
    """A read that names the folder, and what is absent or broken in it."""


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Symbols that have a {symbol}.parquet in the folder; none if it is one dataset."""
    at, fs = _hadoop(spark, folder)
    if not fs.exists(at):
        raise ReadError(f"there is no folder {folder}")
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet") and not n.startswith((".", "_", "part-")))


def broken(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Symbols whose file can't be opened, or whose columns don't fit those of the others, with the reason; found by
    halving, so sound files cost little."""
    try:
        spark.read.option("mergeSchema", "true").parquet(*paths.values())
        return {}
    except (PySparkException, Py4JError) as e:
        if len(paths) == 1:
            said = re.search(r"\[[A-Z_.]+\][^\n]*", str(e))
            return {next(iter(paths)): said[0] if said else str(e).splitlines()[0]}
        names = list(paths)
        halves = names[: len(names) // 2], names[len(names) // 2 :]
        found = {s: why for half in halves for s, why in broken(spark, {s: paths[s] for s in half}).items()}
        return found or {names[-1]: "its columns have other types than those of the other files"}


def read_symbols(spark: SparkSession, folder: str, columns: list[str], date: str = "datetime", symbol: str = "symbol", symbols: list[str] | None = None, begin=None, end=None, lenient: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The wanted columns and range of the wanted symbols' files, and what was left out with the reason.  Only these files
    are opened.  Absent and broken files are an error that names them all; `lenient` leaves them out instead.  Columns that
    only some files have are null in the others; a column that no file has is an error; a symbol column that files lack is
    the file's name."""
    there = listing(spark, folder)
    wanted = there if symbols is None else symbols
    out = {s: "there is no such file" for s in wanted if s not in set(there)}
    paths = {s: f"{folder}/{s}.parquet" for s in wanted if s not in out}
    if paths:
        while bad := broken(spark, {s: p for s, p in paths.items() if s not in out}) if len(out) < len(wanted) else {}:
            out |= bad
    left = [p for s, p in paths.items() if s not in out]
    if out and not lenient or not left:
        raise ReadError(f"{folder}: " + ("; ".join(f"{s}: {why}" for s, why in sorted(out.items())) or "no file was asked for"))
    df = spark.read.option("mergeSchema", "true").parquet(*left)
    if symbol not in df.columns:
        df = df.withColumn(symbol, F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.parquet$", ""))
    if lost := [c for c in (date, *columns) if c not in df.columns]:
        raise ReadError(f"{folder}: no file has {', '.join(lost)}")
    df = df.select(*dict.fromkeys([date, symbol, *columns])).withColumn(date, F.col(date).cast("timestamp_ntz"))
    if begin is not None:
        df = df.where(F.col(date) >= F.lit(begin).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("timestamp_ntz"))
    return df, out
