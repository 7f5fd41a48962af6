"""Readers and writers of reports, extracted documents and benchmark facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsift.operators import mapping
from finsift.sources.config import GROUP
from finsift.sources.work import staged, there

_TABLE = "array<map<string,string>>"
#: An extracted document, as one JSON file each.
RAW_DOCUMENT = (
    "metadata map<string,string>, "
    f"financial_data struct<balance_sheet:{_TABLE},income_statement:{_TABLE},cashflow_statement:{_TABLE}>, "
    "management_discussion struct<sections:array<struct<title:string,content:string,page_number:int>>>, "
    "footnotes struct<items:array<struct<name:string,content:string,page_number:int>>>, "
    "company_overview struct<business_description:string,industry_classification:string>, "
    "grids array<struct<table_id:int,title:string,unit:string,page_number:int,rows:array<array<string>>>>"
)
#: Statements and where a document has them.
TABLES = (("balance_sheet", "balance_sheet"), ("profit_loss", "income_statement"), ("cashflow", "cashflow_statement"))
BENCHMARK = "stock_code string, industry string, year int, indicator string, value double"


def named(path: Column) -> tuple[Column, Column]:
    """Stock code and year of a file named ``code_year``."""
    form = r"(\d{6})_(\d{4})[^/]*$"
    return F.regexp_extract(path, form, 1), F.regexp_extract(path, form, 2).try_cast("int")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted documents of a folder with stock_code and year from their names."""
    code, year = named(F.col("_metadata.file_name"))
    return spark.read.schema(RAW_DOCUMENT).option("multiLine", True).json(folder).withColumn("stock_code", code).withColumn("year", year)


def read_pdfs(spark: SparkSession, folder: str, parse: Callable[[bytes], str]) -> DataFrame:
    """(path, stock_code, year, document) of the PDFs of a folder, by a parser that
    gives the JSON of one; any PDF library can be behind it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"path": pdf["path"], "document": [parse(bytes(b)) for b in pdf["content"]]})

    out = files.mapInPandas(run, "path string, document string").withColumn("document", F.from_json("document", RAW_DOCUMENT))
    code, year = named(F.col("path"))
    return out.withColumn("stock_code", code).withColumn("year", year)


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (stock_code, year, ...) that have no extracted document yet."""
    return files.join(done.select("stock_code", "year"), ["stock_code", "year"], "left_anti")


def cells(docs: DataFrame) -> DataFrame:
    """(stock_code, year, statement, row, name, text): cells of the three tables."""
    out = None
    for statement, field in TABLES:
        rows = docs.select("stock_code", "year", F.lit(statement).alias("statement"), F.posexplode(f"financial_data.{field}").alias("row", "cells"))
        rows = rows.select("stock_code", "year", "statement", "row", F.explode("cells").alias("name", "text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def raw_names(docs: DataFrame) -> DataFrame:
    """(raw_name) of the rows of the three tables."""
    return cells(docs).where(~F.col("name").isin("unit", "report_type")).select(F.trim("name").alias("raw_name"))


def facts_of(docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(stock_code, company_name, industry, year, report_type, standard_name, value) of
    extracted documents, in yuan, one for each standard name, and why a cell gave none
    is in :func:`unreadable`.

    A row of a table may name its own unit and report type (unit, report_type);
    else the document's metadata do, else amounts are in yuan and consolidated.
    """
    good = _amounts(docs, aliases).where("standard_name is not null and value is not null")
    best = mapping.preferred(good, ["stock_code", "year", "report_type"])
    return best.select("stock_code", "company_name", "industry", "year", "report_type", "standard_name", "value")


def unreadable(docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(stock_code, year, statement, raw_name, text, reason) of the cells that give no
    fact: "name" outside the vocabulary, "text" that is no amount, unknown "unit"."""
    why = F.when(F.col("standard_name").isNull(), "name").otherwise(F.col("reason"))
    return _amounts(docs, aliases).withColumn("reason", why).where("reason is not null").select("stock_code", "year", "statement", "raw_name", "text", "reason")


def _amounts(docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    own = lambda k: F.try_element_at("metadata", F.lit(k))
    out = None
    for statement, field in TABLES:
        rows = docs.select("stock_code", "year", own("company_name").alias("company_name"), F.col("company_overview.industry_classification").alias("industry"), own("unit").alias("table_unit"), own("report_type").alias("__type"), F.lit(statement).alias("statement"), F.explode(f"financial_data.{field}").alias("r"))
        rows = rows.select("*", F.try_element_at("r", F.lit("unit")).alias("field_unit"), F.coalesce(F.try_element_at("r", F.lit("report_type")), "__type", F.lit(GROUP)).alias("report_type"))
        rows = rows.select(*[c for c in rows.columns if c not in ("r", "__type")], F.explode(F.map_filter("r", lambda k, v: ~k.isin("unit", "report_type"))).alias("raw_name", "text"))
        out = rows if out is None else out.unionByName(rows)
    out = mapping.map_names(mapping.with_amount(out.withColumn("table_unit", F.coalesce("table_unit", F.lit("元")))).withColumnRenamed("statement", "__statement"), aliases)
    # a name counts in its own statement only
    fits = F.col("statement") == F.col("__statement")
    return out.withColumn("standard_name", F.when(fits, F.col("standard_name"))).drop("statement").withColumnRenamed("__statement", "statement")


def report_sections(docs: DataFrame) -> DataFrame:
    """(stock_code, year, title, content, page_number) of discussion and footnotes."""
    said = docs.select("stock_code", "year", F.explode("management_discussion.sections").alias("s")).select("stock_code", "year", "s.title", "s.content", "s.page_number")
    notes = docs.select("stock_code", "year", F.explode("footnotes.items").alias("s")).select("stock_code", "year", F.col("s.name").alias("title"), "s.content", "s.page_number")
    return said.unionByName(notes)


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Peer facts from CSV; codes stay strings, for they begin with zeros."""
    return spark.read.schema(BENCHMARK).option("header", True).csv(path)


def write_benchmarks(facts: DataFrame, path: str) -> None:
    """Peer facts as Parquet by industry and year, so that a scan of one reads no
    other; only the partitions that ``facts`` has are replaced.  The engine splits a
    large industry over tasks and joins small ones."""
    facts.hint("rebalance", "industry", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("industry", "year").parquet(path)


#: Folders of a year that companies are dealt to.
BUCKETS = 64
STORED = "stock_code string, report string, year int, bucket int"


def write_reports(reports: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Reports as JSON lines (stock_code, report) by year and a bucket of the code; a
    rerun replaces its own only: what else the buckets it touches hold is kept."""
    spark = reports.sparkSession
    bucket = F.pmod(F.xxhash64("stock_code"), F.lit(buckets)).cast("int")
    new = staged(reports.select("stock_code", "report", F.col("year").cast("int").alias("year"), bucket.alias("bucket")), "reports")
    out = new
    if there(spark, path):
        old = read_reports(spark, path, buckets).join(new.select("year", "bucket").distinct(), ["year", "bucket"], "left_semi")
        kept = staged(old.join(new.select("stock_code", "year"), ["stock_code", "year"], "left_anti"), "kept")
        out = new.unionByName(kept)
    out.repartition("year", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "bucket").json(path)


def read_reports(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """(stock_code, report, year, bucket) of written reports."""
    return spark.read.schema(STORED).json(path)


def show(reports: DataFrame, n: int = 20) -> None:
    reports.show(n, truncate=False, vertical=True)


#: What a search gives: one row for each result.
SEARCH_RESULT = "query string, rank int, title string, url string, published date, snippet string"


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored search results (JSON lines), the first of each address of a query; the
    search itself is another program's, so runs can be repeated."""
    rows = spark.read.schema(SEARCH_RESULT).json(path).where("url is not null")
    return rows.groupBy("query", "url").agg(F.min(F.struct("rank", "title", "published", "snippet")).alias("r")).select("query", "url", "r.*")


def search_text(results: DataFrame, most: int = 20) -> DataFrame:
    """(search_query, search_results): the ``most`` best results of each query as the
    text that the prompt for facts takes."""
    order = Window.partitionBy("query").orderBy("rank", "url")
    best = results.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    line = F.concat_ws(" ", F.concat(F.lit("["), F.col("published").cast("string"), F.lit("]")), "title", "snippet", F.concat(F.lit("("), F.col("url"), F.lit(")")))
    lines = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))).alias("l"))
    return lines.select(F.col("query").alias("search_query"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("search_results"))


def parts_present(docs: DataFrame) -> DataFrame:
    """Which parts an extracted document has: readable at all, statement tables,
    discussion, and footnotes that all have a text."""
    from finsift.operators.documents import completeness

    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    notes = F.col("footnotes.items")
    named_docs = docs.withColumn("doc", F.concat_ws("_", "stock_code", "year"))
    return completeness(
        named_docs,
        {
            "readable": F.col("metadata").isNotNull() | F.col("financial_data").isNotNull(),
            "has_tables": some("financial_data.balance_sheet") & some("financial_data.income_statement") & some("financial_data.cashflow_statement"),
            "has_discussion": some("management_discussion.sections"),
            "has_notes": some("footnotes.items") & F.forall(notes, lambda x: F.length(x["content"]) > 0),
        },
    )
