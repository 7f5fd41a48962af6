"""Indicators from statements.  The formulas are the usual accounting ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsift.functions.columns import ratio
from finsift.sources import config


def _growth(name: str):
    """Change against the year before, where that year is there and positive."""
    order = Window.partitionBy("stock_code").orderBy("year")
    before = F.when((F.lag("year").over(order) == F.col("year") - 1) & (F.lag(name).over(order) > 0), F.lag(name).over(order))
    return ratio(F.col(name), before) - 1


def derive(wide: DataFrame) -> DataFrame:
    """``wide`` with a column for each indicator of ``config.RATIOS`` and ``GROWTHS``; one
    that lacks a field is null."""
    have = set(wide.columns)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("decimal(38,4)")
    out = wide.withColumns({name: ratio(c(above), c(below)) for name, (above, below) in config.RATIOS.items()})
    return out.withColumns({name: _growth(field) if field in have else F.lit(None).cast("double") for name, field in config.GROWTHS.items()})


def long_form(derived: DataFrame, names: list[str]) -> DataFrame:
    """(stock_code, industry, year, indicator, value), values that are null left out."""
    return derived.select("stock_code", "industry", "year", *names).unpivot(["stock_code", "industry", "year"], names, "indicator", "value").where("value is not null")
