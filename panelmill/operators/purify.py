"""Chained cleaning of a factor, and the list of methods."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession

from ..panel import Panel
from . import neutralize, standardize, winsorize

REGISTRY = {"winsorize": winsorize.METHODS, "neutralize": neutralize.METHODS, "standardize": standardize.METHODS}


def _pick(kind: str, method: str):
    name = neutralize.ALIASES.get(method, method)
    if name not in REGISTRY[kind]:
        raise ValueError(f"unknown {kind} method {method!r}; there are {sorted(REGISTRY[kind])}")
    return REGISTRY[kind][name]


class Purifier:
    """Purifier(panel).winsorize("mad").neutralize("multiOLS", ["beta"]).standardize("zscore").result()

    Each call adds to the plan; nothing runs before an action."""

    def __init__(self, panel: Panel):
        self.panel, self._columns = panel, list(panel.df.columns)

    def winsorize(self, method: str = "mad", *args, **options) -> Purifier:
        self.panel = _pick("winsorize", method)(self.panel, *args, **options)
        return self

    def neutralize(self, method: str = "multiOLS", *args, **options) -> Purifier:
        self.panel = _pick("neutralize", method)(self.panel, *args, **options)
        return self

    def standardize(self, method: str = "zscore", *args, **options) -> Purifier:
        self.panel = _pick("standardize", method)(self.panel, *args, **options)
        return self

    def result(self, columns: list[str] | None = None) -> DataFrame:
        return self.panel.df.select(*(columns or self._columns))


def methods(spark: SparkSession, kind: str | None = None, method: str | None = None) -> DataFrame:
    """category, method, parameter, default, doc."""
    rows = []
    for category, own in REGISTRY.items():
        for name, f in own.items():
            if (kind or category) == category and (method or name) == name:
                doc = (inspect.getdoc(f) or "").split("\n")[0]
                rows += [(category, name, q.name, "" if q.default is q.empty else repr(q.default), doc) for q in list(inspect.signature(f).parameters.values())[1:]] or [(category, name, "", "", doc)]
    return spark.createDataFrame(rows, "category string, method string, parameter string, default string, doc string")
