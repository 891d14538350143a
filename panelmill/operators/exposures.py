"""Exposures of a portfolio or of a pure factor, and attribution of returns by a regression per date."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import over_rows, pairs_combined, pairs_of, updated
from ..functions.expr import complete, correlation, ndiv, quantile_bin
from ..functions.order import numbered
from ..panel import Panel
from .neutralize import least_squares


def prepared(p: Panel, exposures: list[str], period: int = 1, fac_shift: int | None = None, mode: str = "on", step: dt.timedelta | None = None, pure: bool = False, return_mode: str = "lagged") -> DataFrame:
    """date, symbol, factor, fut_ret and exposures on the rows that count, exposures (and a pure factor) as z-scores per
    date.  return_mode "lagged" compares with the price `period` rows before, "forward" with the one after."""
    p = p.lagged([p.factor, *exposures], fac_shift or 0)
    p = p.with_df(complete(p.df, [p.date, p.symbol, p.price, *exposures]))
    other = F.lag(p.price, period).over(p.in_time) if return_mode == "lagged" else F.lead(p.price, period).over(p.in_time)
    ret = ndiv(F.nullif(other, F.lit(0.0)), F.nullif(F.col(p.price), F.lit(0.0))) - 1
    df = p.df.withColumn("fut_ret", F.nullif(ret, F.lit(-1.0)))
    if period > 1:
        df = df.join(numbered(df.select(p.date).distinct(), p.date, "_place"), p.date)
    keep = F.col("_place") % period == 0 if period > 1 else F.lit(True)
    if mode != "on":
        last = F.max(p.date).over(W.partitionBy(p.symbol, F.to_date(p.date)))
        df = df.withColumn("_night", F.col(p.date) + F.expr(f"INTERVAL '{period * step.total_seconds()}' SECOND") > last)
        keep = {("off", False): ~F.col("_night") | keep, ("off", True): ~F.col("_night"), ("only", False): F.col("_night") | keep, ("only", True): F.col("_night")}[mode, pure]
    df = df.where(keep).select(p.date, p.symbol, p.factor, "fut_ret", *exposures)
    scaled = [p.factor, *exposures] if pure else exposures
    df = df.withColumns({c: ndiv(F.col(c) - F.avg(c).over(p.by_date), F.stddev_samp(c).over(p.by_date)) for c in scaled})
    return complete(df, [p.factor, *exposures])


def _attributed(p: Panel, fits: DataFrame, columns: list[str], intercept: str, total: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    df = fits.select(p.date, *(zero(f"{c}_expo").alias(f"{c}_expo") for c in columns), F.coalesce("intercept", F.lit(0.0)).alias(intercept), *(F.coalesce(F.col("coef")[k], F.lit(0.0)).alias(c) for k, c in enumerate(columns)))
    df = df.withColumns({f"{c}_attr": F.col(f"{c}_expo") * F.col(c) for c in columns})
    portfolio = F.col(intercept)
    for c in columns:
        portfolio = portfolio + F.col(f"{c}_attr")
    df = df.withColumn("portfolio_ret", portfolio)
    order = W.orderBy(p.date).rowsBetween(W.unboundedPreceding, W.currentRow)  # a row for each date is left
    curve = lambda c: F.product(1 + F.col(c)).over(order) - 1
    return df.withColumns({**{f"{c}_cum_ret": curve(f"{c}_attr") for c in columns}, f"{intercept}_cum_ret": curve(intercept), total: curve("portfolio_ret")})


def portfolio_exposures(p: Panel, exposures: list[str], bins: int = 5, position: str = "ls", **options) -> DataFrame:
    """Mean exposures of the top bin (1: largest factor), the negated bottom bin, or both, with return attribution."""
    if bins < 2:
        raise ValueError(f"a top and a bottom bin need at least 2 bins, not {bins}")
    df = prepared(p, exposures, **options).withColumn("quantile", quantile_bin(F.col(p.factor), bins, p.date, p.symbol, descending=True)).dropna(subset=["fut_ret"])
    legs = {"l": [1], "s": [bins], "ls": [1, bins]}[position]
    signed = lambda c: F.when(F.col("quantile") == bins, -F.col(c)).otherwise(F.col(c)) if position != "l" else F.col(c)
    in_leg = F.col("quantile").isin(legs)
    fits = least_squares(df, p.date, "fut_ret", exposures, F.count_if(in_leg).alias("n_legs"), *(F.avg(F.when(in_leg, signed(c))).alias(f"{c}_expo") for c in exposures))
    return _attributed(p, fits.where("n_legs > 0"), exposures, "intercept", "portfolio_cum_ret")


def pure_exposures(p: Panel, exposures: list[str], **options) -> DataFrame:
    """Exposures of weights factor / sum |factor|; a date with a null return has no coefficients, so 0."""
    df = prepared(p, exposures, pure=True, **options)
    w = ndiv(F.col(p.factor), F.sum(F.abs(p.factor)).over(p.by_date))
    fits = least_squares(df.withColumn("weight", w), p.date, "fut_ret", exposures, F.count_if(F.col("fut_ret").isNull()).alias("n_nulls"), *(F.sum(F.col("weight") * F.col(c)).alias(f"{c}_expo") for c in exposures))
    fits = fits.withColumns({c: F.when(F.col("n_nulls") == 0, F.col(c)) for c in ("coef", "intercept")})
    return _attributed(p, fits, exposures, "Alpha", f"{p.factor}_cum_ret")


def correlations(df: DataFrame, date: str, factor: str, exposures: list[str]) -> DataFrame:
    """date, corr_<exposure>: correlation of the factor with each exposure."""
    return df.groupBy(date).agg(*(correlation(F.col(factor), F.col(c)).alias(f"corr_{c}") for c in exposures))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr for all pairs, pooled over dates, over rows where both are present; from one pass of partial sums.  A pair
    with a constant column has null."""
    k = len(columns)

    def of(r: dict) -> dict:
        _, _, square, product = r["sums"].reshape(4, k, k)
        scale = np.sqrt(square * square.T)
        return {"corr": [float(c / s) if s > 0 else None for c, s in zip(product.ravel(), scale.ravel())]}

    sums = over_rows(df.withColumn("_all", F.lit(0)), "_all", [F.col(c) for c in columns], pairs_of, pairs_combined)
    corr = updated(sums, of, "corr array<double>").select(F.posexplode("corr").alias("at", "corr"))
    names = F.array(*map(F.lit, columns))
    return corr.select(F.get(names, F.floor(F.col("at") / k).cast("int")).alias("a"), F.get(names, F.col("at") % k).alias("b"), "corr")
