"""From anomalies and causes to a bounded score.

Impacts are signed: bad ones are negative and the score is 100 plus their sum.  A
cause with a class weight counts by it, any other by the indicator's weight, good or
bad by the side on which the indicator deviates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsift.sources import config

SUM = "decimal(38,6)"  # sums of decimals don't depend on their order


def amplification(multiple: Column, cap: Column) -> Column:
    return F.least(1 + multiple / 3, cap)


def effective_multiple(multiple: Column, zero_mad: Column, cap: Column) -> Column:
    """The multiple, or where there is none the one at which the cap is reached."""
    return F.when(zero_mad, 3 * (cap - 1)).otherwise(multiple)


def weighted(deviations: DataFrame) -> DataFrame:
    """``deviations`` with the indicator's signed weight, m and the amplification."""
    table = F.broadcast(config.weights(deviations.sparkSession))  # eight indicators
    out = deviations.join(table, "indicator", "left").where("base_weight is not null")
    good = F.when(F.col("direction") == "positive", F.col("above")).otherwise(~F.col("above"))
    out = out.withColumn("weight", F.abs("base_weight") * F.when(good, 1.0).otherwise(-1.0)).withColumn("m", effective_multiple(F.col("multiple"), F.col("zero_mad"), F.col("cap")))
    return out.withColumn("amplification", amplification(F.col("m"), F.col("cap"))).withColumn("effective_weight", F.round(F.col("weight") * F.col("amplification"), 6))


def causes_of(attribution: DataFrame) -> DataFrame:
    """(stock_code, year, indicator, source, cause, p, cause_weight), a row a cause."""
    table = F.broadcast(config.causes(attribution.sparkSession))  # four causes
    return attribution.select("stock_code", "year", "indicator", "source", F.explode("probabilities").alias("cause", "p")).join(table, "cause", "left")


def deviation_impacts(deviations: DataFrame, attribution: DataFrame) -> DataFrame:
    """(stock_code, year, indicator, expected, impact): the expected weight over all
    causes, and that times the multiple."""
    causes = causes_of(attribution).where("source = 'C'")
    out = weighted(deviations).join(causes, ["stock_code", "year", "indicator"])
    one = F.col("p") * F.coalesce("cause_weight", "weight") * F.col("amplification")
    out = out.groupBy("stock_code", "year", "indicator").agg(F.sum(F.round(one, 6).cast(SUM)).alias("expected"), F.first("m").alias("m"))
    return out.withColumn("impact", F.round(F.col("expected").cast("double") * F.col("m"), 6)).drop("m")


def check_impacts(anomalies: DataFrame, attribution: DataFrame) -> DataFrame:
    """(stock_code, year, check_name, impact): the expected class weight times the
    severity; a check without causes, and a cause without a class, count as fraud."""
    causes = causes_of(attribution).where("source = 'B+'").withColumnRenamed("indicator", "check_name")
    weights = causes.groupBy("stock_code", "year", "check_name").agg(F.sum(F.round(F.col("p") * F.coalesce("cause_weight", F.lit(-3.0)), 6).cast(SUM)).alias("expected"))
    out = anomalies.join(weights, ["stock_code", "year", "check_name"], "left")
    return out.select("stock_code", "year", "check_name", F.round(F.coalesce(F.col("expected").cast("double"), F.lit(-3.0)) * F.col("severity"), 6).alias("impact"))


def tier(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 60, "medium").otherwise("low")


def scores(companies: DataFrame, deviation: DataFrame, checks: DataFrame) -> DataFrame:
    """(stock_code, year, c_impact, bplus_impact, raw_score, final_score, tier) of
    every company-year in ``companies``; without anomalies 100."""
    total = lambda df, name: df.groupBy("stock_code", "year").agg(F.sum(F.col("impact").cast(SUM)).alias(name))
    out = companies.select("stock_code", "year").join(total(deviation, "c_impact"), ["stock_code", "year"], "left").join(total(checks, "bplus_impact"), ["stock_code", "year"], "left")
    zero = F.lit(0).cast(SUM)
    out = out.withColumn("c_impact", F.coalesce("c_impact", zero).cast("double")).withColumn("bplus_impact", F.coalesce("bplus_impact", zero).cast("double"))
    out = out.withColumn("raw_score", F.round(100 + F.col("c_impact") + F.col("bplus_impact"), 6)).withColumn("final_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("raw_score"))))
    return out.withColumn("tier", tier(F.col("final_score")))
