"""A factor study: the backtest and IC tables of a panel, each planned on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.tables import cut_lineage
from .operators import backtest, ic
from .panel import Panel, map_frequency
from .plans.config import AnalysisConfig, ResearchConfig


class FactorStudy:
    """FactorStudy(panel).run().stats is a DataFrame; `run` keeps the two frames that all tables share."""

    def __init__(self, panel: Panel, research: ResearchConfig = ResearchConfig(), analysis: AnalysisConfig = AnalysisConfig()):
        missing = [c for c in (panel.date, panel.symbol, panel.price, panel.factor) if c not in panel.df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        self.panel, self.research, self.analysis = panel.lagged([panel.factor], research.fac_shift or 0), research, analysis

    @cached_property
    def _span(self):
        return self.panel.span()

    @property
    def frequency(self) -> str | None:
        step = self._span[0]
        return self.analysis.agg_freq or (map_frequency(step) if step else None)

    def run(self) -> FactorStudy:
        self.rows, self.calendar, self.drifted = self.rows.persist(), self.calendar.persist(), self.drifted.persist()
        return self

    @cached_property
    def industries(self) -> DataFrame:
        pairs = list((self.analysis.group_by or {}).items())
        return self.panel.df.sparkSession.createDataFrame(pairs, "symbol string, industry string").select(F.col("symbol").cast(self.panel.df.schema[self.panel.symbol].dataType).alias("symbol"), "industry")

    @cached_property
    def rows(self) -> DataFrame:
        """Written once, as the calendar, holdings and their returns all read them."""
        return cut_lineage(backtest.bars(self.panel, self.research.bins))

    @cached_property
    def calendar(self) -> DataFrame:
        return backtest.calendar(self.rows.select("datetime").distinct(), self.research.rebalance_periods)

    @cached_property
    def drifted(self) -> DataFrame:
        return backtest.drift(self.rows, self.calendar)

    @cached_property
    def trades(self) -> DataFrame:
        return backtest.trades(self.drifted, self.research)

    @cached_property
    def per_bar(self) -> DataFrame:
        return backtest.bar_returns(self.drifted, self.trades)

    @property
    def turnover(self) -> DataFrame:
        return backtest.turnover(self.trades, self.research.bins)

    @property
    def returns(self) -> DataFrame:
        out = backtest.returns(self.per_bar)
        return backtest.log_scale(out) if self.analysis.log_scale else out

    @property
    def returns_ls(self) -> DataFrame:
        out = backtest.long_short(self.per_bar, self.research.bins)
        return backtest.log_scale(out) if self.analysis.log_scale else out

    @property
    def stats(self) -> DataFrame:
        return backtest.statistics(self.per_bar, self.turnover, self.research.bins, self._span[1], self.research.base_rate)

    @property
    def returns_agg(self) -> DataFrame:
        return backtest.aggregated(self.per_bar, self.research.bins, self.frequency)

    @property
    def calendar_returns(self) -> DataFrame:
        return backtest.seasonality(self.per_bar, self.research.bins)

    @property
    def industry_returns(self) -> DataFrame:
        return backtest.industry_returns(self.drifted, self.trades, self.industries, self.research.bins)

    @cached_property
    def ic(self) -> DataFrame:
        r = self.research
        return ic.ic_series(self.panel, r.return_horizons, self.analysis.ic_method, r.horizon_rolling_period, r.overnight, self._span[0] if r.overnight != "on" else None)

    @property
    def ic_stats(self) -> DataFrame:
        return ic.ic_statistics(self.ic)

    @property
    def ic_agg(self) -> DataFrame:
        return ic.ic_aggregated(self.ic, self.frequency)

    @property
    def ic_industry(self) -> DataFrame:
        r = self.research
        return ic.industry_contribution(self.panel, self.industries, r.return_horizons, self.analysis.ic_method, r.overnight, self._span[0] if r.overnight != "on" else None)

    def trace(self, period: int | str, date, position: str = "l", full: bool = False) -> DataFrame:
        return backtest.trace(self.panel, self.research, period, date, position, full)

    def trace_rows(self, period: int | str, date=None, bins: list[int] | None = None, position: str = "l") -> DataFrame:
        """What the bins hold around a date, with both epochs where two meet."""
        return backtest.trace_rows(self.panel, self.research, period, date, bins, position)

    def trace_sheet(self, period: int | str, date, position: str = "l") -> tuple[DataFrame, DataFrame, DataFrame]:
        """Holdings, bin returns and old and new weights around a date."""
        return backtest.trace_sheet(self.panel, self.research, period, date, position)
