"""Accounting identities, and the gate that they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsift.functions.columns import ratio
from finsift.sources.config import BLOCKED

BALANCE_TOLERANCE, ROLL_TOLERANCE = 1, 1e-3


def balance(wide: DataFrame) -> DataFrame:
    """Assets equal liabilities and equity, to one yuan; null if a side is missing."""
    right = F.col("Total_Liabilities") + F.col("Equity_Total")
    out = wide.select("stock_code", "year", F.col("Total_Assets").alias("lhs"), right.alias("rhs"))
    return out.withColumn("diff", F.abs(F.col("lhs") - F.col("rhs"))).withColumn("ok", F.col("diff") <= BALANCE_TOLERANCE)


def retained(wide: DataFrame) -> DataFrame:
    """Retained earnings roll forward within a thousandth: end is begin plus net
    profit less dividends."""
    right = F.col("Retained_Begin") + F.col("Net_Profit") - F.col("Dividends")
    out = wide.select("stock_code", "year", F.col("Retained_End").alias("lhs"), right.alias("rhs"))
    out = out.withColumn("diff", F.abs(F.col("lhs") - F.col("rhs")))
    return out.withColumn("ok", F.when(F.col("diff") == 0, True).otherwise(ratio(F.col("diff"), F.abs("lhs")) <= ROLL_TOLERANCE))


def record(wide: DataFrame) -> DataFrame:
    """(stock_code, year, checks, passed): each check as a struct; a company-year
    passes when no check is known to fail."""
    one = lambda df, name: df.select("stock_code", "year", F.struct(F.lit(name).alias("name"), "lhs", "rhs", "diff", "ok").alias("check"))
    every = one(balance(wide), "balance").unionByName(one(retained(wide), "retained"))
    grouped = every.groupBy("stock_code", "year").agg(F.array_sort(F.collect_list("check")).alias("checks"))  # two checks
    return grouped.withColumn("passed", ~F.exists("checks", lambda c: F.coalesce(~c["ok"], F.lit(False))))


def gate(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Company-years that go on, and blocked reports for the others.  One whose
    balance can't be checked goes on."""
    off = F.abs(F.col("Total_Assets") - F.col("Total_Liabilities") - F.col("Equity_Total")) > BALANCE_TOLERANCE
    bad = F.coalesce(off, F.lit(False))
    return wide.where(~bad), wide.where(bad).select("stock_code", "year", F.lit(BLOCKED).alias("message"))
