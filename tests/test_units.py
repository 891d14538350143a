"""Closed forms, invariants and edge panels."""

import datetime as dt
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from estimators import fast_ica, huber_regression, least_squares, ransac, theil_sen
from panelmill.functions import durations, linear
from panelmill.functions.expr import norm_ppf, student_p, week_key
from panelmill.operators import backtest, exposures, neutralize, reports, standardize, winsorize
from panelmill.operators.purify import Purifier, methods
from panelmill.panel import Panel, map_frequency
from panelmill.plans.config import AnalysisConfig, ResearchConfig
from panelmill.sources import store
from panelmill.streaming.bars import closed_bars
from panelmill.study import FactorStudy
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 1)


def panel(spark, rows, extra=""):
    return Panel.of(spark.createDataFrame(rows, f"datetime timestamp_ntz, symbol string, close double, factor double{extra}"))


@pytest.fixture(scope="module")
def market(spark):
    draw = np.random.default_rng(42)
    rows = []
    for s in range(30):
        price = 100 * np.exp(np.cumsum(draw.normal(0, 0.02, 90)))
        for d in range(90):
            rows.append((DAY + dt.timedelta(days=d), f"s{s:02}", float(price[d]), None if d == 89 else float(draw.normal()), float(draw.uniform(0.5, 1.5)), float(draw.normal())))
    return panel(spark, rows, ", beta double, size double").with_df(panel(spark, rows, ", beta double, size double").df.persist())


def test_durations():
    assert durations.shift_datetime(dt.datetime(2024, 3, 31), "1m") == dt.datetime(2024, 2, 29)
    assert durations.shift_datetime(dt.datetime(2024, 1, 1), "1y2m3d4h5min6s", "add") == dt.datetime(2025, 3, 4, 4, 5, 6)
    assert durations.multiply_duration(40, "1d") == "1m10d" and durations.multiply_duration(90, "1min") == "1h30min"
    with pytest.raises(ValueError):
        durations.parse_duration("3 weeks")
    assert map_frequency(dt.timedelta(days=1)) == "20d" and map_frequency(dt.timedelta(hours=1)) == "5d" and map_frequency(dt.timedelta(seconds=4)) is None


def test_normal_quantile_and_week_key(spark):
    p = [1e-12, 1e-6, 0.01, 0.3, 0.5, 0.9, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(norm_ppf(F.col("p"))).collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(x) for x in p], abs=1e-9)
    days = [DAY + dt.timedelta(days=7 * k + k % 7) for k in range(-100, 300)] + [dt.datetime(2023, 12, 31), dt.datetime(2024, 1, 1)]
    got = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz").select("d", week_key(F.col("d")).alias("k")).collect()
    assert all(r.k == r.d.strftime("%Y-%W") for r in got)


def test_nulls_take_the_lowest_places(spark):
    rows = [(DAY, f"s{k}", 1.0, f) for k, f in enumerate([None, 3.0, 1.0, 2.0, None, 5.0, 4.0])]
    got = {r.symbol: r.quantile for r in backtest.binned(panel(spark, rows), 5).collect()}
    assert got == {"s2": 2, "s3": 3, "s1": 3, "s6": 4, "s5": 5}  # places 2..6 of 7


def test_nan_zero_price_and_single_row(spark):
    p = Panel.of(pd.DataFrame({"datetime": [DAY] * 2, "symbol": ["a", "b"], "close": [1.0, 2.0], "factor": [float("nan"), 1.0]}), spark=spark)
    assert p.df.where("factor IS NULL").count() == 1
    rows = [(DAY + dt.timedelta(days=d), "a", c, 1.0) for d, c in enumerate([1.0, 0.0, 2.0, 2.0])]
    got = [r.fut_ret for r in backtest.forward_return(panel(spark, rows), panel(spark, rows).df).orderBy("datetime").collect()]
    assert got == [None, None, 0.0, None]
    alone = panel(spark, rows[:1])
    assert [r.factor for f in (winsorize.mean_std, winsorize.zscore) for r in f(alone).df.collect()] == [1.0, 1.0]
    assert standardize.zscore(alone).df.first().factor is None


def test_backtest_invariants(market):
    c = ResearchConfig(rebalance_periods=(5, "W", "M"))
    s = FactorStudy(market, c).run()
    weights = s.drifted.groupBy("period", "datetime", "quantile").agg(F.sum("w").alias("w")).collect()
    assert weights and all(r.w == pytest.approx(1) for r in weights)
    traded = s.trades.groupBy("period", "datetime", "quantile").agg(F.sum("buy").alias("b"), F.sum("sell").alias("s")).collect()
    first = {}
    for r in sorted(traded, key=lambda r: r.datetime):
        if first.setdefault(r.period, r.datetime) == r.datetime:
            assert (r.b, r.s) == (pytest.approx(1), 0)
        else:
            assert r.b == pytest.approx(r.s)
    assert s.returns_ls.where("ret_net_ls > ret_ls + 1e-12").count() == 0
    assert {(r.period, r.leg) for r in s.stats.collect()} == {(p, leg) for p in ("5", "W", "M") for leg in ("ls", "l", "s")}
    near = s.trace(5, DAY + dt.timedelta(days=10), "ls")
    assert near.select("datetime").distinct().count() == 3 and near.where("quantile = 1 AND weight_lag_1 > 0").count() == 0
    with pytest.raises(ValueError):
        s.trace(5, dt.datetime(1999, 1, 1))


def test_trace_sheet_dates(spark, market):
    s = FactorStudy(market, ResearchConfig(rebalance_periods=(5,)))
    dates = sorted(r[0] for r in s.rows.select("datetime").distinct().collect())
    for at, wide, narrow in ((0, [0, 1], [1]), (1, [0, 1, 2], [1, 2]), (7, [5, 6, 7, 8], [6, 7, 8])):
        holdings, returns, weights = s.trace_sheet(5, dates[at], "ls")
        seen = lambda df: sorted({r.datetime for r in df.collect()})
        assert seen(holdings) == [dates[i] for i in wide] and seen(returns) == [dates[i] for i in narrow]
        assert seen(weights) == [dates[i] for i in narrow if i in (5, 10)]
    assert {r.quantile for r in holdings.collect()} == {1, 5}
    with pytest.raises(ValueError):
        s.trace_sheet(5, dt.datetime(1999, 1, 1))
    both = s.trace_rows(5, dates[5], [5, 1]).collect()
    assert sorted({r.datetime for r in both}) == dates[3:7] and {r.quantile for r in both} == {1, 5}
    assert {r.g for r in both if r.datetime == dates[5]} == {0, 1}  # two epochs meet
    short = {(r.datetime, r.g, r.quantile, r.symbol): r.w for r in s.trace_rows(5, dates[5], position="s").collect()}
    assert {r.quantile for r in s.trace_rows(5, dates[5]).collect()} == {1, 2, 3, 4, 5} and all(short[r.datetime, r.g, r.quantile, r.symbol] == -r.w for r in both)
    with pytest.raises(ValueError):
        s.trace_rows(5, dates[5], position="ls")
    assert backtest.around([1, 2, 3, 4], 4, 2, 1) == [2, 3, 4] and backtest.around([1, 2, 3, 4], 4, 1, 1) == [3, 4]


def test_trace_where_epochs_meet_by_hand(spark):
    """One symbol a bin, rebalanced every two bars: the last return of the old epoch stands on the meeting date."""
    price = {"a": [1, 2, 4, 4, 2, 2], "b": [1, 1, 1, 2, 2, 3], "c": [2, 1, 1, 1, 3, 3]}
    rows = [(DAY + dt.timedelta(days=d), s, float(v[d]), float("abc".index(s))) for s, v in price.items() for d in range(6)]
    traced = backtest.traced(panel(spark, rows), ResearchConfig(bins=3), 2)
    assert all(r.w == 1 for r in traced.collect()) and traced.where("buy > 0").count() == 3
    got = {(r.quantile, (r.datetime - DAY).days): (r.ret, r.ret_s) for r in backtest.traced_returns(traced).collect()}
    assert got[1, 1] == (1.0, -1.0) and got[1, 2] == (1.0, -1.0)  # bars of days 0 and 1
    assert got[1, 3] == (1.0, -1.0)  # day 2 is a meeting: day 1's return again
    assert got[1, 4] == (-0.5, 0.5)


def test_dummies_are_absorbed(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    rows = [(DAY, f"s{i:02}", 1.0, float(draw.normal()), float(draw.normal()), "abc"[i % 3], "xy"[i % 7 % 2]) for i in range(40)] + [(DAY, "t", 1.0, 1.0, 1.0, None, "x")]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, symbol string, close double, factor double, beta double, one string, two string")
    got = {r.symbol: r.factor for r in neutralize.multi_ols(Panel.of(df), ["beta"], ["one", "two"]).df.collect()}
    x = np.array([[1, r[4], r[5] == "b", r[5] == "c", r[6] == "y"] for r in rows[:40]], float)
    y = np.array([r[3] for r in rows[:40]])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert len(got) == 40 and np.allclose([got[r[1]] for r in rows[:40]], want)


def test_four_symbols_by_hand(spark):
    price = {"a": [1, 2, 4, 4], "b": [1, 1, 1, 2], "c": [2, 1, 1, 1]}
    rows = [(DAY + dt.timedelta(days=d), s, float(v[d]), float("abc".index(s))) for s, v in price.items() for d in range(4)]
    bars = backtest.bars(panel(spark, rows), 3)
    held = backtest.drift(bars, backtest.calendar(bars.select("datetime").distinct(), (2,)))
    got = {(r.symbol, (r.datetime - DAY).days): (r.g, r.w, r.fut_ret) for r in held.collect()}
    assert got["a", 0] == (0, 1.0, 1.0) and got["a", 1] == (0, 1.0, 1.0) and got["a", 2] == (1, 1.0, 0.0) and got["c", 0] == (0, 1.0, -0.5)
    pair = backtest.drift(bars.withColumn("quantile", F.lit(1)), backtest.calendar(bars.select("datetime").distinct(), (3,)))
    weights = {(r.symbol, (r.datetime - DAY).days): r.w for r in pair.collect()}
    assert weights["a", 1] == pytest.approx(2 / 3.5) and weights["c", 1] == pytest.approx(0.5 / 3.5) and weights["a", 2] == pytest.approx(4 / 5.5)


def test_config():
    assert ResearchConfig(tax_rate=0.01, tax_rate_direction="both").fees == (pytest.approx(0.0113),) * 2
    for bad in ({"bins": 2}, {"tax_rate_direction": "x"}, {"overnight": "x"}):
        with pytest.raises(ValueError):
            ResearchConfig(**bad)


def test_every_method_runs_and_residuals_are_orthogonal(market):
    assert sum(len(m) for m in (winsorize.METHODS, neutralize.METHODS, standardize.METHODS)) == 42
    out = neutralize.multi_ols(market, ["beta", "size"]).df
    dots = out.groupBy("datetime").agg(F.sum(F.col("factor") * F.col("beta")).alias("a"), F.sum("factor").alias("b")).collect()
    assert len(dots) == 89 and all(abs(r.a) < 1e-8 and abs(r.b) < 1e-8 for r in dots)
    same = neutralize.ica(market, ["beta", "size"]).df.select("datetime", "symbol", F.col("factor").alias("f")).join(out, ["datetime", "symbol"])
    assert same.where("abs(f - factor) > 1e-9").count() == 0
    small = market.with_df(market.df.where(F.col("datetime") < F.lit(DAY + dt.timedelta(days=3)).cast("timestamp_ntz")))
    for name in neutralize.METHODS:
        assert Purifier(small).neutralize(name, ["beta", "size"]).result().count() == 90
    assert neutralize.ica_components(small, ["beta", "size"]).count() == 90
    assert neutralize.partial_correlation(small, ["beta"], "size", "spearman").count() == 3
    assert neutralize.coefficients(small, ["beta"], "ridge").columns == ["datetime", "coef", "intercept"]
    with pytest.raises(ValueError):
        Purifier(small).winsorize("none")


def test_estimators():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0]
    dirty = y.copy()
    dirty[:12] += 40
    for coef, intercept in (ransac(x, dirty, 2.5)[:2], theil_sen(x, dirty), huber_regression(x, y)):
        assert np.allclose(coef, [2, -1], atol=0.35) and intercept == pytest.approx(1, abs=0.35)
    assert np.abs(huber_regression(x, dirty)[0] - [2, -1]).max() < np.abs(least_squares(x, dirty)[0] - [2, -1]).max() + 0.5
    a = np.array([[1.0], [2.0], [3.0]])
    assert np.allclose(linear.kernel_ridge_fit(a, a[:, 0], 1.0, "linear"), a[:, 0] * 14 / 15)
    step = (x[:, 0] > 0).astype(float)
    assert np.allclose(linear.boosting_fit(x, step, 1, 1.0, 1), step) and np.abs(linear.forest_fit(x, step, 30) - step).mean() < 0.2
    m = (len(x), x.mean(0), y.mean(), np.cov(x.T, bias=True), np.array([np.mean((c - c.mean()) * (y - y.mean())) for c in x.T]), y.var())
    for f in (linear.ols, linear.bayesian_ridge):
        assert np.allclose(f(*m)[0], [2, -1], atol=1e-3)
    assert np.allclose(linear.elastic_net(*m, alpha=0.0)[0], [2, -1], atol=1e-3)
    s = fast_ica(np.column_stack([draw.uniform(-1, 1, 500), draw.uniform(-1, 1, 500)]) @ [[1, 0.5], [0.3, 1]], 2)
    assert np.allclose(np.cov(s.T, bias=True), np.eye(2), atol=1e-6)


def test_student_p_values(spark):
    """Against the closed forms for 1, 2 and 4 degrees of freedom, and an integral for many."""
    forms = {1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(2 + t * t), 4: lambda t: 1 - (u := t / math.sqrt(4 + t * t)) * (1 + 0.5 * (1 - u * u))}
    cases = [(t, float(n)) for n in (*forms, 10, 99, 5000) for t in (0.0, 1e-3, 0.3, 1.0, 2.0, 7.0)]
    got = spark.createDataFrame(cases, "t double, n double").select("t", "n", student_p(F.col("t"), F.col("n")).alias("p"), student_p(-F.col("t"), F.col("n")).alias("q")).collect()
    for r in got:
        angle = np.linspace(math.atan(r.t / math.sqrt(r.n)), math.pi / 2, 400_001)
        whole = np.linspace(0, math.pi / 2, 400_001)
        want = forms[int(r.n)](r.t) if r.n in forms else np.trapezoid(np.cos(angle) ** (r.n - 1), angle) / np.trapezoid(np.cos(whole) ** (r.n - 1), whole)
        assert r.p == r.q == pytest.approx(want, abs=1e-8)
    odd = spark.createDataFrame([(1.0, 0.0), (None, 5.0), (float("inf"), 5.0)], "t double, n double").select(student_p(F.col("t"), F.col("n")).alias("p")).collect()
    assert [r.p for r in odd] == [None, None, 0.0]


def test_exposures(market):
    for position in ("l", "s", "ls"):
        out = exposures.portfolio_exposures(market, ["beta", "size"], position=position)
        gap = out.where("abs(portfolio_ret - intercept - beta_attr - size_attr) > 1e-12")
        assert out.count() > 80 and gap.count() == 0
    pure = exposures.pure_exposures(market, ["beta"], return_mode="forward", mode="on", fac_shift=1)
    assert "factor_cum_ret" in pure.columns and pure.count() > 80
    with pytest.raises(ValueError):
        exposures.portfolio_exposures(market, ["beta"], bins=1)


def test_reports_and_methods(spark, market):
    s = FactorStudy(market, ResearchConfig(rebalance_periods=("M",), return_horizons=(1,)), AnalysisConfig(group_by={"s01": "x", "s02": "x", "s03": "x"}))
    for sheet in reports.full_sheet(s).values():
        assert all(df.columns for df in sheet.values())
    assert reports.ic_sheet(s)["stats"].first().p_value <= 1
    assert {r.industry for r in s.ic_industry.collect()} <= {"x", "Unlabeled"}
    assert methods(spark).select("category", "method").distinct().count() == 42
    assert sum(r["count"] for r in reports.histogram(market.df, "beta").collect()) == market.df.count()
    assert list(reports.correlation_sheet(exposures.correlations(market.df, "datetime", "factor", ["beta"]), "datetime"))[:2] == ["series", "means"]


def test_as_of_keeps_nulls_of_the_matched_row(spark):
    t = lambda d: DAY + dt.timedelta(days=d)
    left = spark.createDataFrame([(t(1), "a"), (t(3), "a"), (t(3), "b"), (t(9), "a")], "datetime timestamp_ntz, symbol string")
    right = spark.createDataFrame([(t(2), "a", 1.0), (t(3), "a", None), (t(8), "a", 7.0), (t(8), "a", 7.0), (t(4), "b", 5.0)], "datetime timestamp_ntz, symbol string, eps double")
    got = {(r.symbol, (r.datetime - DAY).days): r.eps for r in store.as_of(left, right, "datetime", "symbol").collect()}
    assert got == {("a", 1): None, ("a", 3): None, ("b", 3): None, ("a", 9): 7.0}


def test_store_round_trip(spark, tmp_path):
    t = lambda d: DAY + dt.timedelta(days=d)
    for s in "ab":
        frame = pd.DataFrame({"datetime": [t(d) for d in range(6)], "symbol": s, "close": [float(d) for d in range(6)]})
        for name, df in (("base", frame), ("alpha", frame.rename(columns={"close": "alpha"})), ("fund", frame.iloc[::3].rename(columns={"close": "eps"}))):
            (tmp_path / name).mkdir(exist_ok=True)
            df.to_parquet(tmp_path / name / f"{s}.parquet", coerce_timestamps="us")
    c = store.Catalog(str(tmp_path), {"base": ["close"]}, {"alpha": ["alpha"]}, {"fund": ["eps"]})
    got = {(r.symbol, r.close): (r.alpha, r.eps) for r in store.load(spark, c, begin=t(2), end=t(5), shift_n=1).collect()}
    assert got == {(s, float(d)): (float(d - 1), 3.0 if d >= 3 else 0.0) for s in "ab" for d in range(2, 6)}
    out = str(tmp_path / "factors")
    new = spark.createDataFrame([(t(0), "a", 1.0), (t(1), "a", 2.0)], "datetime timestamp_ntz, symbol string, f double")
    store.save(spark, new, out, ["f"])
    store.save(spark, spark.createDataFrame([(t(1), "a", 9.0), (t(2), "a", 3.0)], new.schema), out, ["f"], append=True)
    store.save(spark, spark.createDataFrame([(t(0), "a", 5.0, 1.5), (t(7), "a", 8.0, None)], "datetime timestamp_ntz, symbol string, f double, h double"), out, ["f", "h"])
    assert [(r.f, r.h) for r in spark.read.parquet(out).orderBy("datetime").collect()] == [(5.0, 1.5), (2.0, None), (3.0, None)]
    assert store.start_of("discrete", t(0)) == t(-150) and store.start_of("continuous", t(0), 2, "1d") == dt.datetime(2023, 11, 21)
    with pytest.raises(ValueError):
        store.join_discrete([new.select("f"), new.select("symbol")])


def test_closed_bars_in_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    q = closed_bars(stream).writeStream.format("memory").queryName("bars").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.datetime, r.symbol): r.n for r in spark.table("bars").collect()}
    want = {(r.datetime, r.symbol): r.n for r in closed_bars(events).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and not math.isnan(sum(got.values()))
