"""Distance of an indicator from its peers in median absolute deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsift.functions.columns import middle, summed_up  # noqa: F401 - middle is read by queries
from finsift.operators.peers import FEWEST
from finsift.sources import config


def level(multiple: Column) -> Column:
    return F.when(multiple > config.EXTREME, "extreme").when(multiple > config.ABNORMAL, "abnormal").otherwise("normal")


def deviations(indicators: DataFrame, values: DataFrame) -> DataFrame:
    """(stock_code, year, indicator, actual, median, mad, multiple, signed, zero_mad,
    n_peers, low_confidence, severity).

    Where all peers agree a value equal to theirs deviates by 0; any other one has
    no multiple, is marked zero_mad and counts as extreme.
    """
    out = indicators.select("stock_code", "year", "indicator", F.col("value").alias("actual")).join(values, ["stock_code", "year", "indicator"])

    def of(m: Column) -> Column:
        apart = F.col("actual") - m["median"]
        return F.struct(m["median"].alias("median"), m["mad"].alias("mad"), F.when(m["mad"] > 0, apart / m["mad"]).when(apart == 0, F.lit(0.0)).alias("signed"), ((m["mad"] == 0) & (apart != 0)).alias("zero_mad"), (apart > 0).alias("above"))

    # a struct behind a generator is computed once; plain columns would be inlined again wherever they are read
    out = out.select("stock_code", "year", "indicator", "actual", "n_peers", F.explode(F.transform(F.array(summed_up(F.col("values"))), of)).alias("__d"))
    out = out.select("stock_code", "year", "indicator", "actual", "__d.median", "__d.mad", "__d.signed", F.abs("__d.signed").alias("multiple"), "__d.zero_mad", "__d.above", "n_peers")
    out = out.withColumn("severity", F.when(F.col("zero_mad"), "extreme").otherwise(level(F.col("multiple"))))
    return out.withColumn("low_confidence", F.col("n_peers") < FEWEST)


def outliers(found: DataFrame) -> DataFrame:
    """Those above the threshold."""
    return found.where("severity <> 'normal'")


def sentence(found: DataFrame) -> DataFrame:
    """A sentence on each deviation, with its direction."""
    side = F.when(F.col("above"), "高于").otherwise("低于")
    return found.withColumn("summary", F.when(F.col("zero_mad"), F.concat(side, F.lit("同行中位数（同行无差异）"))).otherwise(F.concat(side, F.lit("同行中位数 "), F.round("multiple", 1).cast("decimal(20,1)").cast("string"), F.lit("倍 MAD"))))
