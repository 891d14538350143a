"""Kernel ridge and forests in passes, against plain estimators of one cross-section."""

import numpy as np
import pandas as pd
import pytest
from panelmill.functions import linear
from panelmill.functions.blocks import packed
from panelmill.operators import kernels, neutralize
from panelmill.panel import Panel
from pyspark.sql import functions as F


def cross_sections(sizes, seed=0):
    draw = np.random.default_rng(seed)
    parts = [pd.DataFrame({"datetime": pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=d), "symbol": np.arange(n), "close": 1.0, "factor": draw.normal(size=n), "a": draw.normal(size=n), "b": draw.integers(0, 9, n) / 4.0}) for d, n in enumerate(sizes)]
    return pd.concat(parts)


def residuals(rows, fit):
    out = {}
    for date, g in rows.groupby("datetime"):
        y = g["factor"].to_numpy()
        out |= dict(zip(zip(g["datetime"], g["symbol"]), y - fit(g[["a", "b"]].to_numpy(), y)))
    return out


def close(got, want):
    assert len(got) == len(want) and max(abs(want[r.datetime, r.symbol] - r.factor) for r in got.itertuples()) < 1e-8


@pytest.mark.parametrize("options", [{}, {"gamma": 3.0, "alpha": 0.2}, {"kernel": "poly", "coef0": -0.5}, {"kernel": "linear"}])
def test_kernel_ridge_equals_a_solve_of_the_matrix(spark, options):
    rows = cross_sections([1, 2, 60, 90])
    got = neutralize.kernelridge(Panel(spark.createDataFrame(rows)), ["a", "b"], **options).df.toPandas()
    close(got, residuals(rows, lambda x, y: linear.kernel_ridge_fit(x, y, **options)))


def test_kernel_ridge_by_gradients_over_tiles(spark):
    rows = cross_sections([40, 1])
    df = spark.createDataFrame(rows).withColumn("row", F.monotonically_increasing_id())
    blocks = packed(df, "datetime", F.col("symbol"), F.col("factor"), [F.col("a"), F.col("b"), F.col("row")], most=16)
    fits = df.join(kernels.kernel_ridge(blocks, 2, most=0), "row").withColumn("factor", F.col("factor") - F.col("fit"))
    close(fits.toPandas(), residuals(rows, linear.kernel_ridge_fit))


def test_kernel_ridge_of_a_large_cross_section(spark):
    """Its kernel matrix would have 12.8 GB; on few distinct regressors the same fit has a small form."""
    n = 40_000
    df = spark.range(n).selectExpr("timestamp '2024-01-01' AS datetime", "id AS symbol", "1D AS close", "(id * 7919) % 1013 / 100 AS factor", "id % 5 / 2D AS a", "id % 3 - 1D AS b")
    got = neutralize.kernelridge(Panel(df), ["a", "b"]).df.select("symbol", "factor").toPandas().sort_values("symbol")["factor"].to_numpy(float)
    i = np.arange(n)
    y, own, each = (i * 7919) % 1013 / 100, i % 15, np.arange(15)
    small = linear.kernel_of(*[np.column_stack([each % 5 / 2, each % 3 - 1.0])] * 2, "rbf", 0.5)
    fit = small @ np.linalg.solve(np.bincount(own)[:, None] * small + np.eye(15), np.bincount(own, y))
    assert np.abs(got - (y - fit[own])).max() < 1e-8


def plain_tree(x, y, depth, min_leaf):
    """A tree by recursion, node by node."""
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for middle in (values[1:] + values[:-1]) / 2 if depth and np.ptp(y) else ():
            left = x[:, j] <= middle
            if min(left.sum(), (~left).sum()) >= min_leaf:
                gain = left.sum() * (y[left].mean() - y.mean()) ** 2 + (~left).sum() * (y[~left].mean() - y.mean()) ** 2
                if best is None or gain > best[0] + 1e-12:
                    best = gain, left
    out = np.full(len(y), y.mean())
    for part in (best[1], ~best[1]) if best else ():
        out[part] = plain_tree(x[part], y[part], depth - 1, min_leaf)
    return out


@pytest.mark.parametrize("depth, min_leaf", [(64, 1), (3, 1), (64, 4)])
def test_levels_of_nodes_equal_recursion(depth, min_leaf):
    rows = cross_sections([70])
    x, y = rows[["a", "b"]].to_numpy(), rows["factor"].to_numpy()
    got = linear.forest_fit(x, y, 2, 2, depth, min_leaf, bootstrap=False)
    assert np.allclose(got, plain_tree(x, y, depth, min_leaf))


def test_forest_does_not_depend_on_how_rows_and_trees_are_dealt(spark, monkeypatch):
    rows = cross_sections([1, 2, 50, 300])
    df = spark.createDataFrame(rows)
    got = neutralize.randomforest(Panel(df), ["a", "b"]).df.toPandas().sort_values(["datetime", "symbol"])
    again = neutralize.randomforest(Panel(df.repartition(7, "symbol")), ["a", "b"]).df.toPandas().sort_values(["datetime", "symbol"])
    assert np.allclose(got["factor"], again["factor"]) and len(got) == len(rows)
    one = rows[rows["datetime"] == rows["datetime"].max()]
    x, y = one[["a", "b"]].to_numpy(), one["factor"].to_numpy()
    together = linear.forest_sums(x, y, range(50))
    monkeypatch.setattr(linear, "TOGETHER", 1)
    assert np.allclose(together, linear.forest_sums(x, y, range(20)) + linear.forest_sums(x, y, range(20, 50)))
