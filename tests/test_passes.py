"""Fits that take several passes over blocks, against plain restatements over whole cross-sections."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from estimators import fast_ica, huber_regression, least_squares
from panelmill.functions.blocks import packed
from panelmill.operators import exposures, neutralize, robust, winsorize
from panelmill.panel import Panel
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 1)
K = 2


def cross_sections(seed=5):
    """Dates of many, few, one and no more rows than coefficients, with outliers, an exact fit and a constant regressor."""
    draw = np.random.default_rng(seed)
    rows = []
    for d, n in enumerate((150, 40, 9, 4, 3, 2, 1, 60, 50)):
        x = draw.normal(size=(n, K)) * [1.0, 30.0] + [0.0, 5000.0]
        y = 3 + x @ [2.0, -0.1] + draw.normal(size=n) * (0 if d == 7 else 1)
        y[: n // 6] += draw.normal(0, 40, n // 6) if d != 7 else 0
        if d == 8:
            x[:, 0] = 1.5
        rows += [(DAY + dt.timedelta(days=d), f"s{i:03}", 1.0 + i, float(y[i]), *map(float, x[i])) for i in range(n)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return cross_sections()


@pytest.fixture(scope="module")
def panel(spark, rows):
    return Panel.of(spark.createDataFrame(rows, "datetime timestamp_ntz, symbol string, close double, factor double, a double, b double").repartition(5))


@pytest.fixture(scope="module", params=[7, 8192])
def blocks(panel, request):
    return packed(panel.df, "datetime", F.col("symbol"), F.col("factor"), [F.col("a"), F.col("b")], request.param)


@pytest.fixture(scope="module")
def by_date(panel, rows):
    keys = {r.symbol: r.key for r in panel.df.select("symbol", F.xxhash64("symbol").alias("key")).distinct().collect()}
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {d: (np.array([r[4:] for r in own]), np.array([r[3] for r in own]), np.array([keys[r[1]] for r in own]).astype(np.int64).view(np.uint64)) for d, own in out.items()}


def fits(df):
    return {r[0]: (np.array(r.coef), r.intercept) for r in df.collect()}


def residuals(fit, x, y):
    return y - fit[1] - x @ fit[0]


def test_huber_equals_reweighting(blocks, by_date):
    got = fits(robust.huber(blocks, 1.35, 0.0, 100, 1e-9))
    assert set(got) == set(by_date)
    for d, (x, y, _) in by_date.items():
        z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1)
        if len(x) > K + 1:
            assert residuals(got[d], x, y) == pytest.approx(residuals(huber_regression(z, y, max_iter=3000, tol=1e-13), z, y), abs=1e-6)


def test_huber_with_a_penalty(panel, by_date):
    some = panel.df.where(F.col("datetime") == F.lit(DAY).cast("timestamp_ntz"))
    got = fits(robust.huber(packed(some, "datetime", F.col("symbol"), F.col("factor"), [F.col("a"), F.col("b")]), 1.35, 0.3, 60, 1e-6))
    x, y, _ = by_date[DAY]
    z = x - x.mean(0)
    assert residuals(got[DAY], x, y) == pytest.approx(residuals(huber_regression(z, y, alpha=0.3, max_iter=3000, tol=1e-13), z, y), abs=1e-4)


def numbers(keys, trials, seed):
    """The lots again, one by one."""

    def mixed(v):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = (v ^ v >> shift) * by % 2**64
        return v ^ v >> 31

    return np.array([[(mixed(int(k) ^ mixed(t + 1 + (seed << 32))) >> 11) / 2**53 for t in range(trials)] for k in keys])


@pytest.mark.parametrize("min_samples", [0.5, None, 6])
def test_consensus_has_the_rows_of_a_plain_search(blocks, by_date, min_samples):
    trials, threshold = 30, 2.0
    got = fits(robust.consensus(blocks, threshold, trials, min_samples, 3))
    assert set(got) == set(by_date)
    for d, (x, y, keys) in by_date.items():
        if len(x) < 9 or x[:, 0].std() < 1e-9:
            continue
        lot, best = numbers(keys, trials, 3), None
        for t in range(trials):
            rows = np.flatnonzero(lot[:, t] < min_samples) if isinstance(min_samples, float) else np.argsort(lot[:, t])[: max(min_samples or 0, K + 1)]
            if len(rows) <= K:
                continue
            error = np.abs(residuals(least_squares(x[rows], y[rows]), x, y))
            score = (-(error <= threshold).sum(), round(error[error <= threshold].sum(), 9))
            if best is None or score < best[0]:
                best = score, error <= threshold
        want = least_squares(x[best[1]], y[best[1]])
        assert residuals(got[d], x, y) == pytest.approx(residuals(want, x, y), abs=1e-6)


def test_theil_sen_is_the_spatial_median_of_the_same_fits(blocks, by_date):
    most = 60
    got = fits(robust.theil_sen(blocks, most, 3000, 1e-12, 1))
    for d, (x, y, keys) in by_date.items():
        n = len(x)
        if n <= K or x[:, 0].std() < 1e-9:
            continue
        lot = numbers(keys, most, 1)
        sets = list(combinations(range(n), K + 1)) if math.comb(n, K + 1) <= most else [np.argsort(lot[:, t])[: K + 1] for t in range(most)]
        points = np.array([np.linalg.solve(np.column_stack([np.ones(K + 1), x[list(s)]]), y[list(s)]) for s in sets])
        want = robust.spatial_median(points, 3000, 1e-12)
        far = lambda m: np.linalg.norm(points - m, axis=1).sum()
        mine = np.concatenate([[got[d][1]], got[d][0]])
        assert far(mine) <= far(want) * (1 + 1e-6) + 1e-6


def test_one_regressor_theil_sen_by_hand(spark):
    rows = [(DAY, f"s{i}", 1.0, y, float(i)) for i, y in enumerate([0.0, 1.0, 2.0, 3.0, 40.0])]
    p = Panel.of(spark.createDataFrame(rows, "datetime timestamp_ntz, symbol string, close double, factor double, a double"))
    got = [r.factor for r in neutralize.theilsen(p, ["a"]).df.orderBy("symbol").collect()]
    assert got[:4] == pytest.approx([0] * 4, abs=0.05) and got[4] == pytest.approx(36, abs=0.2)


def test_sources_are_those_of_the_plain_iteration(spark):
    draw = np.random.default_rng(2)
    rows = []
    for d in range(2):
        x = np.column_stack([draw.uniform(-1, 1, 400), draw.laplace(size=400), draw.normal(0, 1e-3, 400)]) @ draw.normal(size=(3, 3))
        rows += [(DAY + dt.timedelta(days=d), f"s{i:03}", 1.0, 0.0, *map(float, x[i])) for i in range(400)]
    p = Panel.of(spark.createDataFrame(rows, "datetime timestamp_ntz, symbol string, close double, factor double, a double, b double, c double"))
    got = neutralize.ica_components(p, ["a", "b", "c"], 2, tol=1e-10).orderBy("datetime", "symbol").collect()
    for d in range(2):
        mine = np.array([r.sources for r in got[400 * d : 400 * d + 400]])
        plain = fast_ica(np.array([r[4:] for r in rows[400 * d : 400 * d + 400]]), 2, tol=1e-10)
        assert np.allclose(np.cov(mine.T, bias=True), np.eye(2), atol=1e-8)
        match = np.abs(np.corrcoef(mine.T, plain.T)[:2, 2:])
        assert np.allclose(np.sort(match.max(0)), 1, atol=1e-4)


def test_hundred_regressors_and_two_sets_of_dummies(spark):
    draw = np.random.default_rng(1)
    n, k = 400, 100
    x = draw.normal(size=(n, k)) + 1000
    y = x[:, :5].sum(1) + draw.normal(size=n)
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(k)]).assign(datetime=DAY, symbol=[f"s{i:03}" for i in range(n)], close=1.0, factor=y, one=[f"g{i % 11}" for i in range(n)], two=[f"h{i * 7 % 13}" for i in range(n)])
    p = Panel.of(frame, spark=spark)
    p = p.with_df(p.df.repartition(4))
    got = {r.symbol: r.factor for r in neutralize.multi_ols(p, [f"c{i}" for i in range(k)], ["one", "two"]).df.collect()}
    full = np.column_stack([x - 1000, pd.get_dummies(frame["one"]).to_numpy(float), pd.get_dummies(frame["two"]).to_numpy(float)])
    want = y - full @ np.linalg.lstsq(full, y, rcond=None)[0]
    assert [got[s] for s in frame["symbol"]] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("names", [["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]])
def test_least_squares_where_regressors_depend(spark, names):
    draw = np.random.default_rng(4)
    rows = []
    for d, n in enumerate((30, 3, 1, 30)):
        x = draw.normal(size=(n, 4))
        x[:, 1] = x[:, 0] * 2 if d == 0 else x[:, 1]
        x[:, 2] = 7.0 if d == 3 else x[:, 2]
        rows += [(DAY + dt.timedelta(days=d), f"s{i:02}", 1.0, float(draw.normal()), *map(float, x[i])) for i in range(n)]
    p = Panel.of(spark.createDataFrame(rows, "datetime timestamp_ntz, symbol string, close double, factor double, a double, b double, c double, d double"))
    got = {(r.datetime, r.symbol): r.factor for r in neutralize.multi_ols(p, names).df.collect()}
    for day in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == day]
        x, y = np.array([r[4 : 4 + len(names)] for r in own]), np.array([r[3] for r in own])
        assert [got[r[:2]] for r in own] == pytest.approx(residuals(least_squares(x, y), x, y), abs=1e-7)


def test_text_regressors_and_too_many_categories(spark, monkeypatch):
    rows = [(DAY, f"s{i}", 1.0, float(i % 4), "n/a" if i == 2 else str(i), f"g{i}") for i in range(8)]
    p = Panel.of(spark.createDataFrame(rows, "datetime timestamp_ntz, symbol string, close double, factor double, a string, g string"))
    assert neutralize.multi_ols(p, ["a"]).df.count() == 7
    monkeypatch.setattr(neutralize, "CATEGORIES", 3)
    with pytest.raises(ValueError, match="more than 3 categories"):
        neutralize.ridge(p, ["a"], ["g"])


def test_correlations_over_pairs_that_are_there(spark):
    draw = np.random.default_rng(6)
    frame = pd.DataFrame(draw.normal(size=(300, 6)) + 1e6, columns=list("abcdef"))
    frame["b"] += frame["a"]
    frame["e"] = 2.0
    frame = frame.mask(draw.random((300, 6)) < 0.3)
    frame["f"] = np.nan
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)], ", ".join(f"{c} double" for c in frame)).repartition(4)
    got = {(r.a, r.b): r.corr for r in exposures.correlation_matrix(df, list("abcdef")).collect()}
    want = frame.corr()
    for key, c in got.items():
        assert c is None if set(key) & {"e", "f"} else c == pytest.approx(want.loc[key], abs=1e-7)
    assert len(got) == 36


def test_outliers_of_a_line_get_the_fit(spark):
    rows = [(DAY, f"s{i:02}", 1.0, 500.0 if i == 11 else None if i == 3 else 2.0 * i) for i in range(40)] + [(DAY + dt.timedelta(days=1), f"s{i}", 1.0, float(i)) for i in range(4)]
    p = Panel.of(spark.createDataFrame(rows, "datetime timestamp_ntz, symbol string, close double, factor double"))
    got = {(r.datetime, r.symbol): r.factor for r in winsorize.ransac_fit(p, 2.5).df.collect()}
    assert len(got) == 44 and got[DAY, "s11"] == pytest.approx(22, abs=1e-6) and got[DAY, "s03"] is None
    assert all(got[r[:2]] == r[3] for r in rows if r[1] not in ("s11", "s03"))
    edge = {r.symbol: r.factor for r in winsorize.ransac_fit(p, 2.5, replace_with_fit=False).df.collect()}
    assert 22 < edge["s11"] < 500


def test_bayesian_ridge_by_its_plain_fixed_point(panel, by_date):
    got = {(r.datetime, r.symbol): r.factor for r in neutralize.bayesianridge(panel, ["a", "b"]).df.collect()}
    for d, (x, y, _) in by_date.items():
        if len(x) < 9 or x[:, 0].std() < 1e-9:
            continue
        cx, cy, n = x - x.mean(0), y - y.mean(), len(x)
        alpha, lam, w = 1 / y.var(), 1.0, np.zeros(K)
        for _ in range(300):
            before = w
            inverse = np.linalg.inv(lam * np.eye(K) + alpha * cx.T @ cx)
            w = alpha * inverse @ cx.T @ cy
            gamma = K - lam * np.trace(inverse)
            lam = (gamma + 2e-6) / (w @ w + 2e-6)
            alpha = (n - gamma + 2e-6) / (((cy - cx @ w) ** 2).sum() + 2e-6)
            if np.abs(w - before).sum() < 1e-3:
                break
        own = [got[d, f"s{i:03}"] for i in range(n)]
        assert own == pytest.approx(cy - cx @ w, abs=1e-5)
