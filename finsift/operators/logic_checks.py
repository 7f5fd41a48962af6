"""Checks within one company's statements.  Each gives rows (stock_code, year,
check_name, value, threshold, severity) for what it flags, severity 0 to 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsift.functions.columns import clamp, ratio
from finsift.sources import config

CASH, HIGH, GAP = "净现比/收现比", "存贷双高", "母子资金分离度"
COLUMNS = ("stock_code", "year", "check_name", "value", "threshold", "severity")


def severity(check: str, value: Column) -> Column:
    """Severity of a check from its ratio: the cash ratio, the product of the two
    high ratios, or the gap between group and parent."""
    if check == CASH:
        return F.when(value < 0, 5.0).otherwise(clamp(F.round((config.CASH_NORMAL - value) / 0.2 * 2, 6), 0.0, 5.0))
    if check == HIGH:
        return F.when(value > 0.3, 5.0).when(value >= 0.1, F.round(2 + (value - 0.1) / 0.2, 6)).otherwise(1.0)
    if check == GAP:
        return F.when(value > config.GAP_SEVERE, 5.0).when(value > config.GAP_WARNING, 3.0).otherwise(0.0)
    raise ValueError(check)


def _rows(df: DataFrame, name: str, value: Column, threshold: float) -> DataFrame:
    out = df.withColumn("check_name", F.lit(name)).withColumn("value", F.round(value, 6)).withColumn("threshold", F.lit(threshold))
    return out.withColumn("severity", severity(name, value)).select(*COLUMNS)


def cash_ratios(wide: DataFrame) -> DataFrame:
    """Cash from operations over net profit, where that is positive, and cash
    received over revenue."""
    profit = F.when(F.col("Net_Profit") > 0, F.col("Net_Profit"))
    return wide.select("stock_code", "year", ratio(F.col("Operating_Cash_Flow"), profit).alias("cash_to_profit"), ratio(F.col("Operating_Cash_Inflow"), F.col("Revenue_Total")).alias("cash_to_revenue"))


def cash_levels(wide: DataFrame) -> DataFrame:
    """(stock_code, year, ratio, value, level): each cash ratio against its range,
    "severe" below its severe threshold, "low" below the range, "high" above it."""
    both = cash_ratios(wide).unpivot(["stock_code", "year"], ["cash_to_profit", "cash_to_revenue"], "ratio", "value").where("value is not null")
    level = lambda low, high, severe: F.when(F.col("value") < severe, "severe").when(F.col("value") < low, "low").when(F.col("value") > high, "high").otherwise("normal")
    return both.withColumn("level", F.when(F.col("ratio") == "cash_to_profit", level(*config.CASH_TO_PROFIT)).otherwise(level(*config.CASH_TO_REVENUE)))


def cash_quality(wide: DataFrame) -> DataFrame:
    """Both cash ratios below normal."""
    low = cash_ratios(wide).where((F.col("cash_to_profit") < config.CASH_NORMAL) & (F.col("cash_to_revenue") < config.CASH_NORMAL))
    return _rows(low, CASH, F.col("cash_to_profit"), config.CASH_NORMAL)


def dual_high(wide: DataFrame) -> DataFrame:
    """Much cash beside much debt that bears interest."""
    both = wide.select("stock_code", "year", ratio(F.col("Monetary_Funds"), F.col("Total_Assets")).alias("a"), ratio(F.col("Interest_Debt"), F.col("Total_Assets")).alias("b"))
    both = both.where((F.col("a") > config.BOTH_HIGH) & (F.col("b") > config.BOTH_HIGH))
    return _rows(both, HIGH, F.col("a") * F.col("b"), config.BOTH_HIGH)


def parent_gap(group: DataFrame, parent: DataFrame) -> DataFrame:
    """Cash of the group that isn't its parent's, over the group's assets; a company
    without a parent report isn't judged."""
    own = parent.select("stock_code", "year", F.col("Monetary_Funds").alias("__parent"))
    both = group.join(own, ["stock_code", "year"], "left")
    gap = ratio(F.col("Monetary_Funds") - F.col("__parent"), F.col("Total_Assets"))
    return _rows(both.where(gap > config.GAP_WARNING), GAP, gap, config.GAP_WARNING)


def anomalies(group: DataFrame, parent: DataFrame) -> DataFrame:
    return cash_quality(group).unionByName(dual_high(group)).unionByName(parent_gap(group, parent))


def anomaly_names(found: DataFrame) -> DataFrame:
    """The flagged checks of each company-year, by name, without a verdict."""
    return found.groupBy("stock_code", "year").agg(F.array_sort(F.collect_set("check_name")).alias("checks"))  # three checks
