"""From recognised cells to standard facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsift.functions.columns import AMOUNT, amount
from finsift.sources import config


def fetch_cells(cells: DataFrame, guide: DataFrame) -> DataFrame:
    """The cells that a header guide points at: equal document, table, row and
    column (both from 0).  ``guide`` is as large as the documents are many and its files
    are many times smaller than its rows, so it is merged and never broadcast."""
    return cells.join(guide.hint("merge"), ["doc", "table_id", "row", "col"])


def with_amount(raw: DataFrame) -> DataFrame:
    """Amounts in yuan from text: the field's unit wins over the table's, and an
    unknown unit or unreadable text gives null with a reason."""
    spark = raw.sparkSession
    out = raw.withColumn("unit", F.coalesce("field_unit", "table_unit")).withColumn("parsed", amount(F.col("text")))
    out = out.join(F.broadcast(config.units(spark)), "unit", "left")  # three rows
    reason = F.when(F.col("parsed").isNull(), "text").when(F.col("factor").isNull(), "unit")
    return out.withColumn("value", (F.col("parsed") * F.col("factor")).cast(AMOUNT)).withColumn("reason", reason).drop("parsed", "factor")


def map_names(raw: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rows with the standard name of their raw name; null where there is none.  Learned
    ``aliases`` (see :mod:`finsift.operators.naming`) count where the vocabulary has no
    such name; they grow with the names met, so the engine picks their join."""
    names = F.broadcast(config.fields(raw.sparkSession))  # the vocabulary
    out = raw.withColumn("raw_name", F.trim("raw_name")).join(names, "raw_name", "left")
    if aliases is None:
        return out
    learned = aliases.groupBy("raw_name").agg(F.max_by(F.struct("standard_name", "statement", "priority"), F.struct("confidence", "standard_name")).alias("__a"))
    fields = ("standard_name", "statement", "priority")
    return out.join(learned, "raw_name", "left").withColumns({c: F.coalesce(c, F.col(f"__a.{c}")) for c in fields}).drop("__a")


def unmapped(raw: DataFrame) -> DataFrame:
    """Names outside the vocabulary with the number of their rows."""
    names = F.broadcast(config.fields(raw.sparkSession).select("raw_name"))
    return raw.withColumn("raw_name", F.trim("raw_name")).join(names, "raw_name", "left_anti").groupBy("raw_name").agg(F.count("*").alias("n_rows"))


def preferred(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key and standard name: the name of best priority, then the
    lesser name and value."""
    order = Window.partitionBy(*keys, "standard_name").orderBy("priority", "raw_name", "value")
    return mapped.where("standard_name is not null").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def statements(facts: DataFrame, names: list[str], keys: tuple[str, ...] = ("stock_code", "year")) -> DataFrame:
    """Facts of one report type, side by side: a column for each standard name."""
    return facts.groupBy(*keys).pivot("standard_name", names).agg(F.first("value"))


def of_type(facts: DataFrame, report_type: str) -> DataFrame:
    return facts.where(F.col("report_type") == report_type)
