"""Neutralizers: the factor is replaced by the residual of a fit per date on neutralizer columns and dummies.

Rows with a null factor or regressor are dropped, as there is no fit for them.  Least squares on few regressors is an
expression over moments in windows, so the panel is read once and never leaves the JVM.  Other linear methods need only
each date's moments, of any number of columns: one pass gives them as partial sums, a worker solves one small system for
each date, and residuals are an expression on the panel.  Robust methods take several such passes over blocks of a table
with the needed columns (see `robust.py`), so no date has to fit in a task; kernel ridge does too (`kernels.py`).  A task
that grows some trees of a forest, or boosts, has one date's rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import linear
from ..functions.blocks import gram, packed, parted, updated
from ..functions.expr import complete
from ..functions.tables import cut_lineage
from ..panel import Panel
from . import kernels, robust

#: Regressors up to which least squares is an expression; more go through partial sums of arrays.
CLOSED = 3
#: Categories of a dummy column that becomes columns.
CATEGORIES = 2000


def number(df: DataFrame, c: str) -> Column:
    """The column as a double; text that isn't a number is null."""
    return F.col(c).try_cast("double") if df.schema[c].dataType.typeName() == "string" else F.col(c).cast("double")


def prepared(p: Panel, cols: list[str], dummies: list[str] | None = None, scale_x: bool = False) -> tuple[DataFrame, list[str]]:
    """The frame with regressors x_0.. and their names: columns scaled over the whole frame on request, then dummies
    with a column for each category but the first, in order.  More than CATEGORIES of them are an error."""
    df = p.df
    x = {}
    if scale_x and cols:
        stats = df.agg(*(f(number(df, c)).alias(f"{n}{k}") for k, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        for k, c in enumerate(cols):
            x[f"x_{k}"] = (number(df, c) - F.lit(stats[f"m{k}"])) / F.lit(stats[f"s{k}"] or 1.0)
    else:
        x = {f"x_{k}": number(df, c) for k, c in enumerate(cols)}
    for d in dummies or []:
        values = sorted(r[0] for r in df.select(d).where(F.col(d).isNotNull()).distinct().limit(CATEGORIES + 1).collect())
        if len(values) > CATEGORIES:
            raise ValueError(f"{d!r} has more than {CATEGORIES} categories; name it first, so that multiOLS absorbs it")
        x |= {f"x_{len(x) + k}": F.when(F.col(d) == v, 1.0).when(F.col(d).isNotNull(), 0.0) for k, v in enumerate(values[1:])}
    return complete(df.withColumns(x), [p.factor, *x]), list(x)


def eliminated(df: DataFrame, k: int) -> DataFrame:
    """Solves each row's normal equations by elimination: columns _s_i_j (covariances of regressors; _s_i_y with y) give
    coefficients _a_i_y.  A regressor that depends on those before it gets 0."""
    s = lambda i, j: F.col(f"_s_{min(i, j)}_{max(i, j)}" if j != "y" else f"_s_{i}_y")
    df = df.withColumns({f"_a_{i}_{j}": s(i, j) for i in range(k) for j in [*range(k), "y"]})
    for i in range(k):
        pivot = F.when(F.col(f"_a_{i}_{i}") > F.col(f"_s_{i}_{i}") * 1e-12, 1 / F.col(f"_a_{i}_{i}")).otherwise(0.0)
        df = df.withColumns({f"_a_{i}_{j}": F.col(f"_a_{i}_{j}") * pivot for j in [*range(k), "y"]} | {"_p": pivot})
        df = df.withColumns({f"_a_{r}_{j}": F.col(f"_a_{r}_{j}") - F.col(f"_a_{r}_{i}") * F.col(f"_a_{i}_{j}") for r in range(k) if r != i for j in [*range(k), "y"]})
    return df


def closed_moments(y: str, xs: list[str], over=None) -> dict[str, Column]:
    """Means _m_i and _m_y and covariances _s_i_j and _s_i_y, as aggregates or, with a window, beside each row."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    out = {f"_m_{i}": at(F.avg(c)) for i, c in enumerate(xs)} | {"_m_y": at(F.avg(y))}
    out |= {f"_s_{i}_{j}": at(F.covar_pop(a, xs[j])) for i, a in enumerate(xs) for j in range(i, len(xs))}
    return out | {f"_s_{i}_y": at(F.covar_pop(c, y)) for i, c in enumerate(xs)}


def least_squares(df: DataFrame, by: str, y: str, xs: list[str], *also: Column) -> DataFrame:
    """by, coef, intercept of a fit for each date, and other aggregates of its rows.  Where regressors are few, all of it is
    one aggregation and an expression over it."""
    if len(xs) > CLOSED:
        fits = solved(moments(complete(df, [y]), by, y, xs), by, linear.ols)
        return df.groupBy(by).agg(*also).join(fits, by, "left") if also else fits
    m = eliminated(df.groupBy(by).agg(*also, *(c.alias(n) for n, c in closed_moments(y, xs).items())), len(xs))
    intercept = F.col("_m_y")
    for i in range(len(xs)):
        intercept = intercept - F.col(f"_a_{i}_y") * F.col(f"_m_{i}")
    kept = [c for c in m.columns if not re.fullmatch(r"_[msap](_\w+)?", c)]
    return m.select(*kept, F.array(*(F.col(f"_a_{i}_y") for i in range(len(xs)))).alias("coef"), intercept.alias("intercept"))


def moments(df: DataFrame, by: str, y: str, xs: list[str]) -> DataFrame:
    """by and sums, the moments of (y, x...) as an array, in one pass."""
    return gram(df, by, [F.col(y), *map(F.col, xs)])


def solved(m: DataFrame, by: str, solver: Callable, **options) -> DataFrame:
    """by, coef array<double>, intercept: a row for each date goes through a worker."""

    def of(r: dict) -> dict:
        coef, intercept = solver(*parted(r["sums"]), **options)
        return {"coef": np.asarray(coef, float), "intercept": float(intercept)}

    return updated(m, of, robust.FIT).withColumnRenamed("by", by)


def applied(p: Panel, df: DataFrame, xs: list[str], fits: DataFrame) -> Panel:
    fit = F.col("intercept")
    for k, c in enumerate(xs):
        fit = fit + F.col(c) * F.col("coef")[k]
    return p.with_df(df.join(fits, p.date).withColumn(p.factor, p.x - fit).select(*p.df.columns))


def _linear(p: Panel, df: DataFrame, xs: list[str], solver: Callable, **options) -> Panel:
    if solver is linear.ols and len(xs) <= CLOSED:
        df = eliminated(df.withColumns(closed_moments(p.factor, xs, p.by_date)), len(xs))
        fit = F.col("_m_y")
        for i, c in enumerate(xs):
            fit = fit + F.col(f"_a_{i}_y") * (F.col(c) - F.col(f"_m_{i}"))
        return p.with_df(df.withColumn(p.factor, p.x - fit).select(*p.df.columns))
    return applied(p, df, xs, solved(moments(df, p.date, p.factor, xs), p.date, solver, **options))


def _robust(p: Panel, df: DataFrame, xs: list[str], fit: Callable, *options) -> Panel:
    blocks = packed(df, p.date, F.col(p.symbol), p.x, [F.col(c) for c in xs])
    return applied(p, df, xs, fit(blocks, *options).withColumnRenamed("by", p.date))


def _numbered(p: Panel, df: DataFrame, xs: list[str], fitted: Callable[[DataFrame], DataFrame]) -> Panel:
    """Residuals by the number of the row: `fitted` gives row and fit of blocks whose last column of x is that number."""
    df = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    blocks = packed(df, p.date, F.col(p.symbol), p.x, [*(F.col(c) for c in xs), F.col("_row")])
    fits = fitted(blocks.withColumnRenamed(p.date, "by")).withColumnRenamed("row", "_row")
    return p.with_df(df.join(fits, "_row").withColumn(p.factor, p.x.cast("double") - F.col("fit")).select(*p.df.columns))


def _rows(p: Panel, df: DataFrame, xs: list[str], fit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Panel:
    factor, keep, order = p.factor, list(p.df.columns), p.symbol

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y = pdf[factor].to_numpy(float)
        pdf[factor] = y - fit(pdf[xs].to_numpy(float), y)
        return pdf[keep]

    schema = p.df.withColumn(factor, p.x.cast("double")).schema
    return p.with_df(df.withColumn(factor, p.x.cast("double")).groupBy(p.date).applyInPandas(one, schema))


def multi_ols(p, cols, dummies=None, scale_x=False):
    """The first set of dummies is absorbed: distances from the means of date and category take its place, so that its
    number of categories doesn't matter."""
    if not dummies:
        return _linear(p, *prepared(p, cols, None, scale_x), linear.ols)
    df, xs = prepared(p.with_df(p.df.dropna(subset=dummies[:1])), cols, dummies[1:], scale_x)
    inside = W.partitionBy(p.date, dummies[0])
    df = df.withColumns({c: F.col(c) - F.avg(c).over(inside) for c in (p.factor, *xs)})
    return _linear(p, df, xs, linear.ols) if xs else p.with_df(df.select(*p.df.columns))


def lasso(p, cols, dummies=None, scale_x=False, alpha=0.01, max_iter=1000, tol=1e-4):
    return _linear(p, *prepared(p, cols, dummies, scale_x), linear.lasso, alpha=alpha, max_iter=max_iter, tol=tol)


def ridge(p, cols, dummies=None, scale_x=False, alpha=1.0):
    return _linear(p, *prepared(p, cols, dummies, scale_x), linear.ridge, alpha=alpha)


def elasticnet(p, cols, dummies=None, scale_x=False, alpha=1.0, l1_ratio=0.5, max_iter=300, tol=1e-4):
    return _linear(p, *prepared(p, cols, dummies, scale_x), linear.elastic_net, alpha=alpha, l1_ratio=l1_ratio, max_iter=max_iter, tol=tol)


def polynomial(p, cols, dummies=None, scale_x=False, degree=2, interaction_only=False, include_bias=True):
    """Projection on all products of up to `degree` regressors; the bias column is the intercept."""
    df, xs = prepared(p, cols, dummies, scale_x)
    pick = combinations if interaction_only else combinations_with_replacement
    terms = [t for d in range(1, degree + 1) for t in pick(xs, d)]
    products = {}
    for k, t in enumerate(terms):
        value = F.lit(1.0)
        for c in t:
            value = value * F.col(c)
        products[f"t_{k}"] = value
    return _linear(p, df.withColumns(products), list(products), linear.ols if include_bias else linear.through_origin)


def kernelridge(p, cols, dummies=None, scale_x=False, alpha=1.0, kernel="rbf", gamma=None, degree=3, coef0=1.0):
    df, xs = prepared(p, cols, dummies, scale_x)
    return _numbered(p, df, xs, lambda blocks: kernels.kernel_ridge(blocks, len(xs), alpha, kernel, gamma, degree, coef0))


def huber(p, cols, dummies=None, scale_x=True, epsilon=1.35, alpha=0.0, max_iter=100, tol=1e-5):
    return _robust(p, *prepared(p, cols, dummies, scale_x), robust.huber, epsilon, alpha, max_iter, tol)


def rank(p, cols, dummies=None, scale_x=False, residual_threshold=2.5, max_trials=100, min_samples=0.5, seed=0):
    """Linear fit by random sample consensus, under the name it is known by."""
    return _robust(p, *prepared(p, cols, dummies, scale_x), robust.consensus, residual_threshold, max_trials, min_samples, seed)


def theilsen(p, cols, dummies=None, scale_x=False, max_subpopulation=1000, max_iter=300, tol=1e-3, seed=0):
    return _robust(p, *prepared(p, cols, dummies, scale_x), robust.theil_sen, max_subpopulation, max_iter, tol, seed)


def randomforest(p, cols, dummies=None, scale_x=False, n_estimators=50, max_features=1, max_depth=None, min_leaf=1, bootstrap=True, seed=0):
    """Trees of a date are dealt to tasks; what a tree draws depends on the seed, its number and the date's rows alone."""
    df, xs = prepared(p, cols, dummies, scale_x)
    return _numbered(p, df, xs, lambda blocks: robust.forest(blocks, len(xs), n_estimators, max_features, max_depth, min_leaf, bootstrap, seed))


def gbdt(p, cols, dummies=None, scale_x=False, n_estimators=50, learning_rate=0.1, max_depth=3, subsample=1.0, seed=0):
    return _rows(p, *prepared(p, cols, dummies, scale_x), lambda x, y: linear.boosting_fit(x, y, n_estimators, learning_rate, max_depth, subsample, seed))


def pca(p, cols, dummies=None, scale_x=True, n_components=10):
    return _linear(p, *prepared(p, cols, dummies, scale_x), linear.principal_components, n_components=n_components)


def ica(p, cols, dummies=None, scale_x=False, n_components=None, max_iter=200, seed=0):
    """Sources are a rotation of the leading principal components (of all regressors, if all are kept), so the residual
    of a fit on them doesn't depend on the rotation; `ica_components` gives the sources themselves."""
    df, xs = prepared(p, cols, dummies, scale_x)
    if n_components is None or n_components >= len(xs):
        return _linear(p, df, xs, linear.ols)
    return _linear(p, df, xs, linear.components_with_intercept, n_components=n_components)


def ica_components(p, cols, n_components=None, max_iter=200, seed=0, tol=1e-4) -> DataFrame:
    """date, symbol and the sources of each date as an array."""
    df, xs = prepared(p, cols)
    turned = robust.components(packed(df, p.date, F.col(p.symbol), p.x, [F.col(c) for c in xs]), n_components or len(xs), max_iter, tol, seed).withColumnRenamed("by", p.date)
    x = F.zip_with(F.array(*xs), "center", lambda a, b: a - b)
    width = (F.size("turn") / F.lit(len(xs))).cast("int")
    source = lambda k: F.aggregate(F.transform(x, lambda v, i: v * F.get("turn", i * width + k)), F.lit(0.0), lambda a, b: a + b)
    sources = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), source)).otherwise(F.array().cast("array<double>"))
    return df.join(turned, p.date).select(p.date, p.symbol, sources.alias("sources"))


def bayesianridge(p, cols, dummies=None, scale_x=False, max_iter=300, tol=1e-3, alpha_1=1e-6, alpha_2=1e-6, lambda_1=1e-6, lambda_2=1e-6):
    return _linear(p, *prepared(p, cols, dummies, scale_x), linear.bayesian_ridge, max_iter=max_iter, tol=tol, a1=alpha_1, a2=alpha_2, l1=lambda_1, l2=lambda_2)


def coefficients(p, cols, method: str = "bayesianridge", dummies=None, scale_x=False, **options) -> DataFrame:
    """date, coef, intercept of a linear method."""
    solver = {"multiOLS": linear.ols, "ridge": linear.ridge, "lasso": linear.lasso, "elasticnet": linear.elastic_net, "bayesianridge": linear.bayesian_ridge, "PCA": linear.principal_components, "partialcorrelation": linear.through_origin}[method]
    df, xs = prepared(p, cols, dummies, scale_x)
    return least_squares(df, p.date, p.factor, xs) if method == "multiOLS" else solved(moments(df, p.date, p.factor, xs), p.date, solver, **options)


def partialcorrelation(p, cols, dummies=None, scale_x=False):
    """Residual of a fit without intercept."""
    return _linear(p, *prepared(p, cols, dummies, scale_x), linear.through_origin)


def partial_correlation(p, cols, target: str, method: str = "pearson", dummies=None, scale_x=False) -> DataFrame:
    """date, partial_corr: correlation of the residuals of the factor and of a target column, both without intercept."""
    from ..functions.expr import average_rank, correlation

    keep = p.with_df(p.df.dropna(subset=[p.factor, target, *cols]))
    a = partialcorrelation(keep, cols, dummies, scale_x).df.select(p.date, p.symbol, p.x.alias("a"))
    b = partialcorrelation(Panel(keep.df, p.date, p.symbol, target, p.price), cols, dummies, scale_x).df.select(p.date, p.symbol, F.col(target).alias("b"))
    both = a.join(b, [p.date, p.symbol])
    if method == "spearman":
        both = both.withColumns({c: average_rank(F.col(c), p.date) for c in ("a", "b")})
    return both.groupBy(p.date).agg(correlation(F.col("a"), F.col("b")).alias("partial_corr"))


METHODS = {
    "multiOLS": multi_ols, "lasso": lasso, "ridge": ridge, "elasticnet": elasticnet, "polynomial": polynomial, "kernelridge": kernelridge, "huber": huber, "rank": rank, "theilsen": theilsen,
    "randomforest": randomforest, "GBDT": gbdt, "PCA": pca, "ICA": ica, "bayesianridge": bayesianridge, "partialcorrelation": partialcorrelation,
}
ALIASES = {"random_forest": "randomforest"}
