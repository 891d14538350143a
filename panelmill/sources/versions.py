"""A store of factor values that is only ever replaced as a whole: versions of symbols, and a manifest that is written last.

A save writes the whole new state of the symbols it touches as one version: files by ranges of symbol and date, sorted, so
that a scan for a symbol skips the others, and a symbol with a third of all rows is written by many tasks.  Then a manifest that names the versions in force
gets the next number by a rename.  A job that dies before that leaves the store as it was, and its files are named by no
manifest; two saves at once can't both take a number, and the later one fails and can be done again.  Readers take the
manifest with the highest number; symbols of a later version hide those of earlier ones.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import appended, updated

#: Versions in force after which a save writes all symbols into one.
MOST_VERSIONS = 8
NAME = re.compile(r"manifest-(\d+)\.json")


class ConflictError(RuntimeError):
    """Another save took the number."""


class Versions:
    """The store in a folder, of rows with a date, a symbol and values."""

    def __init__(self, spark: SparkSession, path: str, date: str = "datetime", symbol: str = "symbol"):
        self.spark, self.path, self.date, self.symbol = spark, path.rstrip("/"), date, symbol
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def manifest(self) -> tuple[int, list[str]]:
        """The highest number and the versions in force, oldest first; 0 and none for a new store."""
        if not self._fs.exists(self._at("")):
            return 0, []
        numbers = [int(m[1]) for f in self._fs.listStatus(self._at("")) if (m := NAME.fullmatch(f.getPath().getName()))]
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.path}/manifest-{max(numbers)}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)["versions"]

    def _publish(self, number: int, versions: list[str]) -> None:
        draft, final = self._at(f".draft-{uuid.uuid4().hex}"), self._at(f"manifest-{number}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"versions": versions}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConflictError(f"another save wrote manifest {number} of {self.path}")

    def _rows(self, versions: list[str]) -> DataFrame | None:
        every, hidden = None, None
        for v in reversed(versions):
            rows = self.spark.read.parquet(f"{self.path}/{v}/rows")
            symbols = self.spark.read.parquet(f"{self.path}/{v}/symbols")
            if hidden is not None:
                rows = rows.join(hidden, self.symbol, "left_anti")
            every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
            hidden = symbols if hidden is None else hidden.union(symbols)
        return every

    def read(self, symbols: list | None = None) -> DataFrame:
        """The rows in force; a list of symbols reaches the scan."""
        rows = self._rows(self.manifest()[1])
        if rows is None:
            raise FileNotFoundError(f"no manifest in {self.path}: nothing was saved there")
        return rows if symbols is None else rows.where(F.col(self.symbol).isin(symbols))

    def save(self, df: DataFrame, factors: list[str], append: bool = False) -> int:
        """Symbols that are there get new dates (append) or new values on the dates they have; new ones are written as they
        are.  Gives the number of the manifest."""
        number, versions = self.manifest()
        new = df.select(self.date, self.symbol, *factors)
        if versions:
            old = self._rows(versions)
            compact = len(versions) >= MOST_VERSIONS
            own = old if compact else old.join(new.select(self.symbol).distinct(), self.symbol, "left_semi")
            there = (appended if append else updated)(own, new, self.date, self.symbol)
            first = new.join(old.select(self.symbol).distinct(), self.symbol, "left_anti")  # symbols that the store doesn't have
            new = there if append else there.unionByName(first, allowMissingColumns=True)
            versions = [] if compact else versions
        version = f"version-{number + 1}-{uuid.uuid4().hex}"
        at = f"{self.path}/{version}"
        columns = [c for c in new.columns if c not in (self.date, self.symbol)]
        dealt = new.select(self.date, self.symbol, *columns).repartitionByRange(self.symbol, self.date).sortWithinPartitions(self.symbol, self.date)
        dealt.write.parquet(f"{at}/rows")
        self.spark.read.parquet(f"{at}/rows").select(self.symbol).distinct().write.parquet(f"{at}/symbols")
        self._publish(number + 1, [*versions, version])
        return number + 1
