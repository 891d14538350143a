"""Information coefficients: correlation of factor and forward return per date, and what follows from the series.

All horizons are one plan with a `horizon` column."""

from __future__ import annotations

import datetime as dt
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import average_rank, correlation, ndiv, student_p
from ..panel import Panel
from .backtest import bucket, forward_return


def with_horizons(p: Panel, horizons: tuple[int, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """horizon, datetime, symbol, factor, fut_ret: one lead for each horizon over one sort."""
    df = p.df
    for h in horizons:
        df = forward_return(p, df, h, f"_r{h}")
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("fut_ret")) for h in horizons)))
    return df.select(F.col(p.date).alias("datetime"), F.col(p.symbol).alias("symbol"), p.x.alias("factor"), *extra, each.alias("x")).select("x.horizon", "datetime", "symbol", "factor", "x.fut_ret", *extra)


def _correlated(df: DataFrame, by: list[str], method: str, count: str | None = None) -> DataFrame:
    valid = F.col("factor").isNotNull() & F.col("fut_ret").isNotNull()
    a, b = F.when(valid, F.col("factor")), F.when(valid, F.col("fut_ret"))
    df = df.withColumns({"_a": a, "_b": b})
    if method == "spearman":
        df = df.withColumns({"_a": average_rank(F.col("_a"), *by), "_b": average_rank(F.col("_b"), *by)})
    return df.groupBy(*by).agg(correlation(F.col("_a"), F.col("_b")).alias("ic"), F.count(F.lit(1)).alias(count or "_n"))


def overnight(df: DataFrame, mode: str, step: dt.timedelta | None, sign: int = 1) -> DataFrame:
    """Keeps rows whose target, horizon steps away, is past the day's last bar (only) or isn't (off).  sign -1 looks
    back, so that nothing is overnight."""
    if mode == "on":
        return df
    last = F.max("datetime").over(W.partitionBy("horizon", F.to_date("datetime")))
    ahead = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("horizon") * sign * step.total_seconds()).cast("decimal(18,6)"))
    past = F.col("datetime") + ahead > F.col("_last")
    return df.withColumn("_last", last).where(past if mode == "only" else ~past).drop("_last")


def rank_autocorrelation(p: Panel, horizons: tuple[int, ...], mode: str = "on", step=None) -> DataFrame:
    """horizon, datetime, autocorr of the dense factor rank with its value `horizon` rows earlier; null where undefined."""
    ranks = p.df.withColumn("_rank", F.when(p.x.isNotNull(), F.dense_rank().over(p.by_date.orderBy(p.x.asc_nulls_last()))))
    lags = ranks.withColumns({f"_l{h}": F.lag("_rank", h).over(p.in_time) for h in horizons})
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_l{h}").alias("lag")) for h in horizons)))
    long = lags.select(F.col(p.date).alias("datetime"), F.col("_rank").cast("double").alias("r"), each.alias("x")).select("datetime", "r", "x.horizon", F.col("x.lag").cast("double").alias("lag"))
    return overnight(long.groupBy("horizon", "datetime").agg(correlation(F.col("r"), F.col("lag")).alias("autocorr")), mode, step, -1)


def ic_series(p: Panel, horizons: tuple[int, ...], method: str = "spearman", rolling: int = 20, mode: str = "on", step=None) -> DataFrame:
    """horizon, datetime, ic, ic_rolling, ic_cum, autocorr on the dates that have an IC."""
    ic = _correlated(with_horizons(p, horizons), ["horizon", "datetime"], method).drop("_n").where(F.col("ic").isNotNull())
    ic = overnight(ic, mode, step)
    order = W.partitionBy("horizon").orderBy("datetime")
    frame = order.rowsBetween(-(rolling - 1), W.currentRow)
    ic = ic.withColumns({"ic_rolling": F.when(F.count("ic").over(frame) >= rolling, F.avg("ic").over(frame)), "ic_cum": F.sum("ic").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))})
    return ic.join(rank_autocorrelation(p, horizons, mode, step), ["horizon", "datetime"], "left")


def industry_contribution(p: Panel, industries: DataFrame, horizons: tuple[int, ...], method: str = "spearman", mode: str = "on", step=None) -> DataFrame:
    """horizon, industry, contrib: IC within the industry times its share of the date's rows, averaged over dates."""
    own = industries.select(F.col("symbol").alias(p.symbol), "industry")
    labelled = p.with_df(p.df.join(own, p.symbol, "left").withColumn("industry", F.coalesce("industry", F.lit("Unlabeled"))))
    ic = _correlated(with_horizons(labelled, horizons, ("industry",)), ["horizon", "datetime", "industry"], method, "n").where(F.col("ic").isNotNull())
    ic = overnight(ic, mode, step)
    weight = F.col("n") / F.sum("n").over(W.partitionBy("horizon", "datetime"))
    return ic.withColumn("c", F.col("ic") * weight).groupBy("horizon", "industry").agg(F.avg("c").alias("contrib"))


def ic_statistics(series: DataFrame, p_value: bool = True) -> DataFrame:
    """horizon, mean, std, skewness and kurtosis (population forms, excess), t_stat, ir, and p_value."""
    s = series.groupBy("horizon").agg(
        F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std"), F.skewness("ic").alias("skewness"), F.kurtosis("ic").alias("kurtosis"), F.avg("autocorr").alias("mean_autocorr"),
    ).withColumns({"t_stat": ndiv(F.col("mean_ic"), F.col("std") / F.sqrt("n")), "ir": ndiv(F.col("mean_ic"), F.col("std"))})
    return s.withColumn("p_value", student_p(F.col("t_stat"), (F.col("n") - 1).cast("double"))) if p_value else s


def ic_aggregated(series: DataFrame, frequency: str | None) -> DataFrame:
    """horizon, agg_date, ic_sum."""
    key = bucket(frequency, F.col("datetime"))
    if key is None:
        return series.limit(0).select("horizon", F.lit("").alias("agg_date"), F.col("ic").alias("ic_sum"))
    return series.groupBy("horizon", key.alias("agg_date")).agg(F.sum("ic").alias("ic_sum"))
