"""Winsorizers: the factor is replaced; statistics are per date unless noted; null bounds leave values unclipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import packed
from ..functions.expr import average_rank, clip, finite, norm_ppf
from ..panel import Panel
from .robust import consensus


def _stages(p: Panel, *stages: dict[str, Column], value: Column) -> Panel:
    df = p.df
    for stage in stages:
        df = df.withColumns(stage)
    return p.with_df(df.withColumn(p.factor, value).select(*p.df.columns))


def mean_std(p: Panel, n: float = 3.0) -> Panel:
    m, s = F.avg(p.x).over(p.by_date), F.stddev_samp(p.x).over(p.by_date)
    return p.with_factor(clip(p.x, m - n * s, m + n * s))


def volatility(p: Panel, k: float = 2.0) -> Panel:
    return mean_std(p, k)


def mad(p: Panel, n: float = 3.0) -> Panel:
    med, dev = F.col("_med"), F.col("_dev")
    return _stages(p, {"_med": F.percentile(p.x, F.lit(0.5)).over(p.by_date)}, {"_dev": F.percentile(F.abs(p.x - med), F.lit(0.5)).over(p.by_date)}, value=clip(p.x, med - n * dev, med + n * dev))


def iqr(p: Panel, k: float = 1.5) -> Panel:
    lo, hi = F.col("_q1"), F.col("_q3")
    q = {name: F.percentile(finite(p.x), F.lit(at)).over(p.by_date) for name, at in (("_q1", 0.25), ("_q3", 0.75))}
    return _stages(p, q, value=clip(finite(p.x), lo - k * (hi - lo), hi + k * (hi - lo)))


def quantile(p: Panel, lower_q: float = 0.01, upper_q: float = 0.99) -> Panel:
    q = {name: F.percentile(finite(p.x), F.lit(at)).over(p.by_date) for name, at in (("_lo", lower_q), ("_hi", upper_q))}
    return _stages(p, q, value=clip(finite(p.x), F.col("_lo"), F.col("_hi")))


def rolling_quantile(p: Panel, window: int = 252, lower_q: float = 0.01, upper_q: float = 0.99) -> Panel:
    """Trailing rows of a symbol, at least one value; the nearest value is the quantile."""
    values = F.sort_array(F.collect_list(p.x).over(p.trailing(window)))
    at = lambda q: F.get("_v", F.round((F.size("_v") - 1) * F.lit(q)).cast("int"))
    return _stages(p, {"_v": values}, value=clip(p.x, at(lower_q), at(upper_q)))


def boxcox_compress(p: Panel, lambda_: float = 0.5) -> Panel:
    s = p.x - F.min(p.x).over(p.by_date) + 1e-9
    return p.with_factor(F.ln(s) if lambda_ == 0 else (F.pow(s, F.lit(lambda_)) - 1) / lambda_)


def zscore(p: Panel, k: float = 3.0) -> Panel:
    m, s = F.avg(p.x).over(p.by_date), F.stddev_samp(p.x).over(p.by_date)
    s = F.when(s == 0, 1e-9).otherwise(s)
    z = (p.x - m) / s
    return p.with_factor(F.when(z > k, m + k * s).when(z < -k, m - k * s).otherwise(p.x))


def rankgauss(p: Panel) -> Panel:
    u = (average_rank(p.x, p.date) - 0.5) / F.count(F.lit(1)).over(p.by_date)
    return _stages(p, {"_u": clip(u, 1e-6, 1 - 1e-6)}, value=norm_ppf(F.col("_u")))


def tanh(p: Panel, scale: float = 1.0) -> Panel:
    m, s = F.avg(p.x).over(p.by_date), F.stddev_samp(p.x).over(p.by_date)
    return p.with_factor(F.tanh((p.x - m) / (s + 1e-12) / scale))


def huber(p: Panel, c: float = 2.0) -> Panel:
    m, s = F.avg(p.x).over(p.by_date), F.stddev_samp(p.x).over(p.by_date)
    z = (p.x - m) / (s + 1e-12)
    return p.with_factor(F.when(z.isNotNull(), F.signum(z) * F.least(F.abs(z), F.lit(float(c))) * s + m))


def ransac_fit(p: Panel, residual_threshold: float = 2.5, replace_with_fit: bool = True, max_trials: int = 100, seed: int = 0) -> Panel:
    """Regression on the place in the cross-section by random sample consensus; outliers of more than threshold standard
    deviations of the residuals get the fit, or the edge of its band.  Fewer than five rows stay."""
    place = (F.row_number().over(W.partitionBy(p.date).orderBy(p.symbol)) - 1).cast("double")
    df = p.df.withColumns({"_place": place, "_y": finite(p.x)})
    blocks = packed(df.where(F.col("_y").isNotNull()), p.date, F.col(p.symbol), F.col("_y"), [F.col("_place")])
    fits = consensus(blocks, residual_threshold, max_trials, None, seed)
    df = df.join(fits.withColumnRenamed("by", p.date), p.date, "left")
    fit = F.col("intercept") + F.col("coef")[0] * F.col("_place")
    df = df.withColumn("_fit", F.when(F.count("_y").over(p.by_date) >= 5, fit))
    band = residual_threshold * F.stddev_pop(F.col("_y") - F.col("_fit")).over(p.by_date)
    far = F.abs(F.col("_y") - F.col("_fit")) > band
    value = F.col("_fit") if replace_with_fit else clip(F.col("_y"), F.col("_fit") - band, F.col("_fit") + band)
    return p.with_df(df.withColumn(p.factor, F.when(far, value).otherwise(p.x)).select(*p.df.columns))


METHODS = {"mean_std": mean_std, "mad": mad, "volatility": volatility, "iqr": iqr, "quantile": quantile, "rolling_quantile": rolling_quantile, "boxcox_compress": boxcox_compress, "zscore": zscore, "rankgauss": rankgauss, "tanh": tanh, "huber": huber, "ransac": ransac_fit}
