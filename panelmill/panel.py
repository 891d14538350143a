"""The panel: rows keyed by date and symbol, with price, factor and exposure columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Panel:
    """A DataFrame and the names of its roles.  `of` cleans a frame at the boundary; operators return a changed copy."""

    df: DataFrame
    date: str = "datetime"
    symbol: str = "symbol"
    factor: str = "factor"
    price: str = "close"

    @staticmethod
    def of(df, date: str = "datetime", symbol: str = "symbol", factor: str = "factor", price: str = "close", spark=None) -> Panel:
        """Takes a Spark or a pandas frame: dates become timestamps without zone and NaN becomes null."""
        if not isinstance(df, DataFrame):
            df = spark.createDataFrame(df)
        floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
        return Panel(df.withColumns({**floats, date: F.col(date).cast("timestamp_ntz")}), date, symbol, factor, price)

    def with_df(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    def with_factor(self, value: Column) -> Panel:
        return self.with_df(self.df.withColumn(self.factor, value))

    @property
    def x(self) -> Column:
        return F.col(self.factor)

    @property
    def by_date(self) -> WindowSpec:
        return W.partitionBy(self.date)

    @property
    def in_time(self) -> WindowSpec:
        return W.partitionBy(self.symbol).orderBy(self.date)

    def trailing(self, rows: int) -> WindowSpec:
        return self.in_time.rowsBetween(-(rows - 1), W.currentRow)

    def lagged(self, columns: list[str], n: int) -> Panel:
        """Values become usable n rows later within a symbol."""
        return self.with_df(self.df.withColumns({c: F.lag(c, n).over(self.in_time) for c in columns})) if n else self

    def span(self) -> tuple[dt.timedelta | None, int]:
        """The step between the first symbol's first two rows, and the days from the first row to the last one, of the
        frame sorted by symbol and date.  Three small rows reach the driver."""
        ordered = self.df.select(self.symbol, self.date)
        head = ordered.orderBy(self.symbol, self.date).limit(2).collect()
        last = ordered.agg(F.max_by(self.date, F.struct(self.symbol, self.date))).first()[0]
        return (head[1][1] - head[0][1] if len(head) > 1 else None), ((last - head[0][1]).days if head else 0)


#: From the step of the data to the length by which results are aggregated.
STEPS = (
    (dt.timedelta(seconds=1), dt.timedelta(seconds=3), "30s"),
    (dt.timedelta(seconds=5), dt.timedelta(seconds=10), "3m"),
    (dt.timedelta(seconds=10), dt.timedelta(seconds=30), "5m"),
    (dt.timedelta(seconds=30), dt.timedelta(minutes=1), "15m"),
    (dt.timedelta(minutes=1), dt.timedelta(minutes=3), "30m"),
    (dt.timedelta(minutes=3), dt.timedelta(minutes=15), "1h"),
    (dt.timedelta(minutes=15), dt.timedelta(days=1), "5d"),
    (dt.timedelta(days=1), dt.timedelta(days=5), "20d"),
    (dt.timedelta(days=5), dt.timedelta(days=365), "1y"),
)


def map_frequency(step: dt.timedelta) -> str | None:
    return next((name for lo, hi, name in STEPS if lo <= step < hi), None)
