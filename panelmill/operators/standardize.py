"""Standardizers: the factor is replaced; statistics are per date unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import average_rank, clip, ndiv, norm_ppf, position, rank_by, when_enough
from ..panel import Panel
from .winsorize import _stages


def _z(p: Panel, x: Column, eps: float | None = None) -> Column:
    m, s = F.avg(x).over(p.by_date), F.stddev_samp(x).over(p.by_date)
    return ndiv(x - m, s) if eps is None else (x - m) / (s + eps)


def zscore(p: Panel) -> Panel:
    return p.with_factor(_z(p, p.x))


def robust_zscore(p: Panel, c: float = 1.4826) -> Panel:
    med = F.col("_med")
    return _stages(p, {"_med": F.percentile(p.x, F.lit(0.5)).over(p.by_date)}, {"_dev": F.percentile(F.abs(p.x - med), F.lit(0.5)).over(p.by_date)}, value=ndiv(p.x - med, F.col("_dev") * c))


def minmax(p: Panel, clip_to_one: bool = True) -> Panel:
    lo, hi = F.min(p.x).over(p.by_date), F.max(p.x).over(p.by_date)
    scaled = ndiv(p.x - lo, hi - lo)
    return p.with_factor(clip(scaled, 0, 1) if clip_to_one else scaled)


def rank(p: Panel, method: str = "average") -> Panel:
    return p.with_factor(rank_by(p.x, method, p.symbol, p.date) / F.count(F.lit(1)).over(p.by_date))


def rank_gaussianize(p: Panel, method: str = "average") -> Panel:
    u = rank_by(p.x, method, p.symbol, p.date) / (F.count(F.lit(1)).over(p.by_date) + 1)
    return _stages(p, {"_u": clip(u, 1e-6, 1 - 1e-6)}, value=norm_ppf(F.col("_u")))


def rolling(p: Panel, window: int = 20, min_periods: int | None = None) -> Panel:
    frame = p.trailing(window)
    value = ndiv(p.x - F.avg(p.x).over(frame), F.stddev_samp(p.x).over(frame))
    return p.with_factor(when_enough(value, p.x, frame, min_periods or window))


def rolling_robust(p: Panel, window: int = 20, min_periods: int | None = None) -> Panel:
    """Deviations are from each row's own trailing median, so 2 * window - 1 rows are needed."""
    frame, least = p.trailing(window), min_periods or window
    med, dev = F.col("_med"), F.col("_absdev")
    return _stages(
        p,
        {"_med": when_enough(F.percentile(p.x, F.lit(0.5)).over(frame), p.x, frame, least)},
        {"_absdev": F.abs(p.x - med)},
        {"_mad": when_enough(F.percentile(dev, F.lit(0.5)).over(frame), dev, frame, least)},
        value=ndiv(p.x - med, 1.4826 * F.col("_mad")),
    )


def rolling_minmax(p: Panel, window: int = 20, min_periods: int | None = None) -> Panel:
    frame = p.trailing(window)
    lo, hi = F.min(p.x).over(frame), F.max(p.x).over(frame)
    return p.with_factor(when_enough(ndiv(p.x - lo, hi - lo), p.x, frame, min_periods or window))


def volatility_scaling(p: Panel, window: int = 20, min_periods: int | None = None, shift_vol: bool = True) -> Panel:
    frame = p.trailing(window)
    vol = when_enough(F.stddev_samp(p.x).over(frame), p.x, frame, min_periods or window)
    used = F.lag("_vol", 1).over(p.in_time) if shift_vol else F.col("_vol")
    return _stages(p, {"_vol": vol}, value=ndiv(p.x, used))


def ewma(p: Panel, lambda_: float = 0.94, eps: float = 1e-12) -> Panel:
    """Weights (1 - lambda) lambda^t by the row's place t in its symbol, summed from the row to the end."""
    place = F.row_number().over(p.in_time) - 1
    weighted = p.x * p.x * (1 - lambda_) * F.pow(F.lit(float(lambda_)), F.col("_t"))
    rest = p.in_time.rowsBetween(W.currentRow, W.unboundedFollowing)
    return _stages(p, {"_t": place}, {"_var": F.sum(weighted).over(rest)}, value=p.x / (F.sqrt("_var") + eps))


def normal_scores(p: Panel, eps: float = 1e-9) -> Panel:
    """Nulls rank first and get scores too."""
    u = (position(p.x, p.date, p.symbol) + 0.5) / F.count(F.lit(1)).over(p.by_date)
    return _stages(p, {"_u": clip(u, eps, 1 - eps)}, value=norm_ppf(F.col("_u")))


def quantile_binning(p: Panel, q: int = 5) -> Panel:
    """0..q-1; nulls are binned too."""
    n = F.count(F.lit(1)).over(p.by_date)
    return p.with_factor(clip(F.floor(position(p.x, p.date, p.symbol) * q / n), 0, q - 1).cast("int"))


def log_zscore(p: Panel, eps: float = 1e-9) -> Panel:
    return _stages(p, {"_ln": F.ln(p.x + eps)}, value=_z(p, F.col("_ln"), eps))


def yeo_johnson(p: Panel, lambda_: float = 0.0, eps: float = 1e-9) -> Panel:
    up = F.ln(p.x + 1) if lambda_ == 0 else (F.pow(p.x + 1, F.lit(float(lambda_))) - 1) / lambda_
    down = -F.ln(1 - p.x) if lambda_ == 2 else -(F.pow(1 - p.x, F.lit(2.0 - lambda_)) - 1) / (2 - lambda_)
    return _stages(p, {"_t": F.when(p.x >= 0, up).when(p.x < 0, down)}, value=_z(p, F.col("_t"), eps))


def boxcox(p: Panel, lambda_: float = 0.0, eps: float = 1e-9) -> Panel:
    """Shifted by the smallest value of the whole frame where that isn't positive."""
    least = p.df.agg(F.min(p.factor)).scalar()
    s = p.x + F.when(least <= 0, eps - least).otherwise(0.0)
    return _stages(p, {"_s": s}, {"_t": F.ln("_s") if lambda_ == 0 else (F.pow("_s", F.lit(float(lambda_))) - 1) / lambda_}, value=_z(p, F.col("_t"), eps))


METHODS = {
    "zscore": zscore, "robust_zscore": robust_zscore, "minmax": minmax, "rank": rank, "rank_gaussianize": rank_gaussianize, "rolling": rolling, "rolling_robust": rolling_robust, "rolling_minmax": rolling_minmax,
    "volatility_scaling": volatility_scaling, "EWMA": ewma, "normal_scores": normal_scores, "quantile_binning": quantile_binning, "log_zscore": log_zscore, "yeo_johnson": yeo_johnson, "boxcox": boxcox,
}
