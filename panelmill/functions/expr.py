"""Column builders: guards for nulls and zero denominators, ranks, bins, normal quantiles, calendar keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fdiv(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is infinite, 0/0 is NaN, null stays null."""
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def ndiv(a: Column, b: Column) -> Column:
    """Division that is null where the denominator is zero."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    """Null stays null; a null bound doesn't bind."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x.isNotNull(), F.greatest(lo, F.least(x, hi)))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in any of the columns, as one condition for each: planning time then grows with their number,
    where a condition on all of them together has the optimizer try every set of their aliases."""
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) if kind in ("double", "float") else F.col(c).isNotNull())
    return df


def average_rank(x: Column, *by: str, descending: bool = False) -> Column:
    """Rank from 1 among non-null values of a group, ties get their mean; null stays null.  Ties are counted in a frame
    of the same order, so one sort serves both."""
    own = W.partitionBy(*by).orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last())
    return F.when(x.isNotNull(), F.rank().over(own) + (F.count(F.lit(1)).over(own.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2)


def rank_by(x: Column, method: str, tie: str, *by: str) -> Column:
    """The rank methods average, min, max, dense, ordinal and random."""
    own = W.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(own.rangeBetween(W.currentRow, W.currentRow))
    ranks = {
        "average": lambda: average_rank(x, *by),
        "min": lambda: F.rank().over(own),
        "max": lambda: F.rank().over(own) + ties - 1,
        "dense": lambda: F.dense_rank().over(own),
        "ordinal": lambda: F.row_number().over(W.partitionBy(*by).orderBy(x.asc_nulls_last(), tie)),
        "random": lambda: F.row_number().over(W.partitionBy(*by).orderBy(x.asc_nulls_last(), F.xxhash64(tie))),
    }
    return F.when(x.isNotNull(), ranks[method]())


def position(x: Column, date: str, tie: str, descending: bool = False) -> Column:
    """Place from 0 in the cross-section; nulls come first when ascending and last when descending."""
    order = x.desc_nulls_last() if descending else x.asc_nulls_first()
    return F.row_number().over(W.partitionBy(date).orderBy(order, F.col(tie))) - 1


def quantile_bin(x: Column, bins: int, date: str, tie: str, descending: bool = False) -> Column:
    """1..bins by position * bins div count; nulls hold places, as the count says."""
    n = F.count(F.lit(1)).over(W.partitionBy(date))
    return F.least(F.floor(position(x, date, tie, descending) * bins / n) + 1, F.lit(bins)).cast("int")


def when_enough(value: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(frame) >= least, value)


def correlation(a: Column, b: Column) -> Column:
    """Pearson by moments over rows where both are present; null where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return ndiv(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def week_key(date: Column) -> Column:
    """%Y-%W: weeks start on Monday, days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7)
    return F.concat_ws("-", F.year(date).cast("string"), F.lpad(week.cast("string"), 2, "0"))


def period_key(period: str, date: Column) -> Column:
    year = F.year(date).cast("string")
    keys = {
        "W": lambda: week_key(date),
        "M": lambda: F.date_format(date, "yyyy-MM"),
        "Q": lambda: F.concat(year, F.lit("-Q"), F.quarter(date).cast("string")),
        "H": lambda: F.concat(year, F.lit("-H"), F.when(F.month(date) <= 6, "1").otherwise("2")),
        "Y": lambda: year,
    }
    if period not in keys:
        raise ValueError(f"period must be a number of bars or one of {sorted(keys)}, got {period!r}")
    return keys[period]()


# Coefficients of algorithm AS 241 (PPND16) for the normal quantile, from the constant term up.
CENTRAL = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 0.000000201033439929228813265),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 0.0000184631831751005468180, 0.000000142151175831644588870, 0.00000000000000204426310338993978564),
)


def _poly(c: tuple[float, ...], x: Column) -> Column:
    out = F.lit(c[-1])
    for value in c[-2::-1]:
        out = out * x + value
    return out


def norm_ppf(p: Column) -> Column:
    """Normal quantile for 0 < p < 1."""
    q = p - 0.5
    central = 0.180625 - q * q
    tail = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    outer = F.when(tail <= 5, _poly(MIDDLE[0], tail - 1.6) / _poly(MIDDLE[1], tail - 1.6)).otherwise(_poly(FAR[0], tail - 5) / _poly(FAR[1], tail - 5))
    return F.when(F.abs(q) <= 0.425, q * _poly(CENTRAL[0], central) / _poly(CENTRAL[1], central)).otherwise(F.signum(q) * outer)


# The asymptotic series of the logarithm of the gamma function, from 1 / x on in odd powers.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: its series ten steps up, and the way back by its recurrence."""
    high = x + 10
    series = F.lit(0.0)
    for c in STIRLING[::-1]:
        series = series / (high * high) + c
    back = F.ln(x)
    for k in range(1, 10):
        back = back + F.ln(x + k)
    return (high - 0.5) * F.ln(high) - high + 0.5 * math.log(2 * math.pi) + series / high - back


def beta_share(x: Column, a: Column, b: Column, terms: int = 200) -> Column:
    """Regularized incomplete beta function for 0 < x < 1 by its continued fraction, evaluated from the inside out with a
    fixed number of terms; accurate where x is below (a + 1) / (a + b + 2)."""
    even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
    odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
    tail = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), lambda below, m: 1 + even(m.cast("double")) / (1 + odd(m.cast("double")) / below))
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
    return front / a / (1 + odd(F.lit(0.0)) / tail)


def student_p(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) of Student's t; null without a degree of freedom or where t is null."""
    half, one = freedom / 2, F.lit(0.5)
    x = freedom / (freedom + t * t)
    inner = F.when(x < (half + 1) / (half + 2.5), beta_share(x, half, one)).otherwise(1 - beta_share(1 - x, one, half))
    return F.when((freedom < 1) | t.isNull(), None).when(t == 0, 1.0).when(F.abs(t) == float("inf"), 0.0).otherwise(inner)
