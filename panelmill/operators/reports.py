"""The tables behind each report sheet, by name; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import norm_ppf
from ..study import FactorStudy


def long_sheet(s: FactorStudy) -> dict[str, DataFrame]:
    edge = F.col("leg").isin("1", str(s.research.bins))
    return {"curves": s.returns.select("period", "datetime", "quantile", "cum_ret", "cum_ret_net"), "turnover": s.turnover.where(edge), "calendar": s.calendar_returns.where("leg = 'l'"), "industries": s.industry_returns, "periods": s.returns_agg.where("leg = 'l'"), "stats": s.stats.where("leg = 'l'")}


def short_sheet(s: FactorStudy) -> dict[str, DataFrame]:
    edge = F.col("leg").isin("1", str(s.research.bins))
    return {"curves": s.returns.select("period", "datetime", "quantile", "cum_ret_s", "cum_ret_net_s"), "turnover": s.turnover.where(edge), "calendar": s.calendar_returns.where("leg = 's'"), "industries": s.industry_returns, "periods": s.returns_agg.where("leg = 's'"), "stats": s.stats.where("leg = 's'")}


def long_short_sheet(s: FactorStudy) -> dict[str, DataFrame]:
    return {"curves": s.returns_ls, "industries": s.industry_returns.select("period", "industry", "ret_net_ls_i_mean"), "turnover": s.turnover.where("leg = 'ls'"), "periods": s.returns_agg.where("leg = 'ls'"), "stats": s.stats.where("leg = 'ls'")}


def qq_points(ic: DataFrame) -> DataFrame:
    """horizon, theoretical, sample: normal quantiles against standardized ICs in order."""
    own = W.partitionBy("horizon")
    z = (F.col("ic") - F.avg("ic").over(own)) / F.nullif(F.stddev_samp("ic").over(own), F.lit(0.0))
    place = F.row_number().over(own.orderBy("ic", "datetime"))
    return ic.select("horizon", ((place - 0.5) / F.count(F.lit(1)).over(own)).alias("u"), z.alias("sample")).select("horizon", norm_ppf(F.col("u")).alias("theoretical"), "sample")


def ic_sheet(s: FactorStudy) -> dict[str, DataFrame]:
    return {"series": s.ic, "industries": s.ic_industry, "qq": qq_points(s.ic), "periods": s.ic_agg, "stats": s.ic_stats}


def full_sheet(s: FactorStudy) -> dict[str, dict[str, DataFrame]]:
    return {"ic": ic_sheet(s), "long_short": long_short_sheet(s), "long": long_sheet(s), "short": short_sheet(s)}


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """bin (0..bins-1), left edge, count; the last bin is closed."""
    lo, hi = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    width = F.nullif((hi - lo) / bins, F.lit(0.0))
    at = F.least(F.floor(F.coalesce((F.col(column) - lo) / width, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).select(at.alias("bin"), (lo + at * F.coalesce(width, F.lit(0.0))).alias("left")).groupBy("bin", "left").count()


def correlation_sheet(per_date: DataFrame, date: str) -> dict[str, DataFrame]:
    columns = [c for c in per_date.columns if c != date]
    return {"series": per_date, "means": per_date.agg(*(F.avg(c).alias(c) for c in columns)), **{f"histogram_{c}": histogram(per_date, c) for c in columns}}
