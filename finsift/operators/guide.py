"""Grids of extracted tables: a guide reads their headers, and coordinates from it fetch
the amounts.  The guide never sees an amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsift.functions.columns import AMOUNT, amount, fenced
from finsift.operators import mapping
from finsift.operators.naming import cleaned
from finsift.sources import config
from finsift.sources.config import GROUP, PARENT

KEY = ["doc", "table_id"]
#: A table as it stands on its page, its rows from top to bottom.
GRID = "array<struct<table_id:int,title:string,unit:string,page_number:int,rows:array<array<string>>>>"
#: An answer to the prompt for guides.
ANSWER = (
    "table_name string, report_type string, unit string, columns map<string,string>, "
    "field_mapping array<struct<raw_name:string,standard_name:string,unit:string,location:struct<row_start:int,col_index:int>>>"
)
_UNIT = "(" + "|".join(sorted((u for u, _ in config.UNITS), key=len, reverse=True)) + ")"


def grid_cells(docs: DataFrame) -> DataFrame:
    """(doc, stock_code, year, company_name, industry, table_id, title, unit, row, col, text)
    of documents with ``grids``; rows and columns count from 0."""
    own = lambda k: F.try_element_at("metadata", F.lit(k))
    cell = lambda g, row, col, text: F.struct(g["table_id"].alias("table_id"), g["title"].alias("title"), F.coalesce(g["unit"], own("unit")).alias("unit"), row.alias("row"), col.alias("col"), text.alias("text"))
    of_row = lambda g: lambda cells, row: F.transform(cells, lambda text, col: cell(g, row, col, text))
    every = F.flatten(F.transform("grids", lambda g: F.flatten(F.transform(g["rows"], of_row(g)))))
    return docs.select(F.concat_ws("_", "stock_code", "year").alias("doc"), "stock_code", "year", own("company_name").alias("company_name"), F.col("company_overview.industry_classification").alias("industry"), F.inline(every))


def headers(cells: DataFrame) -> DataFrame:
    """The cells without an amount: all that a guide may read."""
    return cells.where(F.col("text").isNotNull() & (F.trim("text") != "") & amount(F.col("text")).isNull())


def role(text: Column, year: Column) -> Column:
    """What a column's header says of its period; null for another."""
    bare = F.regexp_replace(text, "[ 　\t]", "")
    words = F.create_map(*[F.lit(x) for r, forms in config.PERIODS for w in forms for x in (w, r)])
    dated = F.regexp_extract(bare, r"^(\d{4})年", 1).try_cast("int")
    closing = bare.rlike("12月31日|末")
    by_date = F.when(dated == year, F.when(closing, "end_balance").otherwise("year")).when(dated == year - 1, F.when(closing, "begin_balance").otherwise("previous_year"))
    return F.coalesce(F.try_element_at(words, bare), by_date, F.when(bare.rlike("[%％]|比例|占比|同比|增减"), "percentage"))


def _told(said: DataFrame) -> DataFrame:
    """The cells of tables whose headers name a period, with __header, the first row that
    does, __periods, its columns (col, role), table_unit and report_type, the last two by
    the title, the document and the texts above the header.

    One window over each table's headers: cells are dealt once and meet no join, so neither
    tables nor cells are ever sent to the driver."""
    table = Window.partitionBy(*KEY)
    known = said.where("doc is not null and table_id is not null").select(*KEY, "year", "title", "unit", "row", "col", "text")
    marked = known.withColumn("__role", role(F.col("text"), F.col("year")))
    marked = marked.withColumn("__header", F.min(F.when(F.col("__role").isNotNull(), F.col("row"))).over(table)).where("__header is not null")
    above = F.col("row") <= F.col("__header")
    stated = F.regexp_extract("text", f"单位[:：]?(?:人民币)?{_UNIT}", 1)
    parent = F.coalesce(F.contains("title", F.lit("母公司")), F.lit(False)) | F.contains("text", F.lit("母公司"))
    told = {
        "__periods": F.collect_list(F.when((F.col("row") == F.col("__header")) & F.col("__role").isNotNull(), F.struct("col", F.col("__role").alias("role")))),  # columns of a table
        "__said": F.min(F.when(above & (stated != ""), stated)),
        "__unit": F.min(F.when(above, F.col("unit"))),
        "__parent": F.max(F.when(above, parent)),
    }
    out = marked.withColumns({n: c.over(table) for n, c in told.items()})
    unit, kind = F.coalesce("__said", "__unit", F.lit("元")), F.when(F.col("__parent"), PARENT).otherwise(GROUP)
    return out.select(*KEY, "row", "col", "text", "__header", "__periods", unit.alias("table_unit"), kind.alias("report_type"))


def header_guide(said: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(doc, table_id, row, col, role, raw_name, standard_name, statement, priority,
    field_unit, table_unit, report_type): where the amounts of known names are, from the
    headers of tables (:func:`headers`) by rule.

    A table's first row that names a period is its header.  Below it, the first text of a
    row is its name; a unit in brackets after it is the field's own.  Names without a
    standard one, in the vocabulary or ``aliases``, are given with null.
    """
    below = _told(said).where((F.col("row") > F.col("__header")) & ~F.array_contains("__periods.col", F.col("col")))
    of_table = ["__periods", "table_unit", "report_type"]
    names = below.groupBy(*KEY, "row").agg(F.min(F.struct("col", "text")).alias("n"), *[F.first(c).alias(c) for c in of_table]).select(*KEY, "row", F.col("n.text").alias("text"), *of_table)
    own = F.regexp_extract("text", f"[（(]{_UNIT}[）)]\\s*$", 1)
    names = names.withColumn("field_unit", F.when(own != "", own)).withColumn("raw_name", cleaned(F.col("text"))).drop("text")
    mapped = mapping.map_names(names, aliases)
    return mapped.select(*[c for c in mapped.columns if c != "__periods"], F.inline("__periods"))


def guide_calls(said: DataFrame) -> DataFrame:
    """(doc, table_id, prompt_name, variables): the call that has a model read a table's
    headers, each as row:column:text."""
    from finsift.sources import prompts

    place = F.concat_ws(":", F.col("row").cast("string"), F.col("col").cast("string"), "text")
    texts = said.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("row", "col", place.alias("t")))).alias("a"))  # headers of a table
    listed = texts.withColumn("table_headers", F.array_join(F.transform("a", lambda x: x["t"]), "\n"))
    return listed.select(*KEY, F.lit("b0_semantic_guide").alias("prompt_name"), prompts.rendered("b0_semantic_guide", {"table_headers": F.col("table_headers")}).alias("variables"))


def answered_guide(said: DataFrame, answers: DataFrame) -> DataFrame:
    """The guide of :func:`header_guide` from answers (doc, table_id, response) to
    :func:`guide_calls`.  A field's location gives its row, and its column if it names
    one; else all columns with a period count.  What isn't a header's text or a standard
    name is left out, so an answer can't point at what it wasn't shown."""
    read = answers.select(*KEY, F.from_json(fenced(F.col("response")), ANSWER).alias("a")).where("a is not null")
    heads = said.select(*KEY, "row", "col", F.trim("text").alias("text"))
    columns = read.select(*KEY, F.explode("a.columns").alias("text", "role")).join(heads, [*KEY, "text"]).groupBy(*KEY, "col").agg(F.min_by("role", "row").alias("role"))
    fields = read.select(*KEY, F.coalesce("a.unit", F.lit("元")).alias("table_unit"), F.when(F.contains("a.report_type", F.lit("母公司")), PARENT).otherwise(GROUP).alias("report_type"), F.explode("a.field_mapping").alias("f"))
    fields = fields.select(*KEY, "table_unit", "report_type", F.trim("f.raw_name").alias("text"), F.col("f.standard_name").alias("standard_name"), F.col("f.unit").alias("field_unit"), F.col("f.location.row_start").alias("row"), F.col("f.location.col_index").alias("__col"))
    shown = heads.select(*KEY, "row", "text").distinct()
    known = config.fields(said.sparkSession).groupBy("standard_name").agg(F.first("statement").alias("statement"))
    rows = fields.join(shown, [*KEY, "row", "text"]).join(F.broadcast(known), "standard_name")  # the vocabulary
    placed = rows.join(columns, KEY).where("__col is null or __col = col")
    return placed.select(*KEY, "row", "text", "standard_name", "statement", F.lit(0).alias("priority"), "field_unit", "col", "role", "table_unit", "report_type").withColumnRenamed("text", "raw_name")


def period_facts(cells: DataFrame, guide: DataFrame) -> DataFrame:
    """(doc, stock_code, year, company_name, industry, report_type, standard_name, role,
    raw_name, value, reason, priority): the amounts that a guide points at, in yuan;
    empty cells are none."""
    at = mapping.fetch_cells(cells.where(F.trim("text") != "").drop("title", "unit"), guide)
    return mapping.with_amount(at).select("doc", "stock_code", "year", "company_name", "industry", "report_type", "standard_name", "statement", "role", "raw_name", "text", "value", "reason", "priority")


def statement_facts(found: DataFrame) -> DataFrame:
    """(stock_code, company_name, industry, year, report_type, standard_name, value) of
    period facts: what stands at the end of the year or for it, and what a field with an
    opening name of its own (``config.OPENINGS``) has at its beginning."""
    opening = F.create_map(*[F.lit(x) for pair in config.OPENINGS for x in pair])
    begun = F.when(F.col("role") == "begin_balance", F.try_element_at(opening, F.col("standard_name")))
    named = found.withColumn("standard_name", F.when(F.col("role").isin("end_balance", "year"), F.col("standard_name")).otherwise(begun))
    # a field's own column comes before another's opening one
    best = mapping.preferred(named.where("value is not null"), ["stock_code", "year", "report_type"])
    return best.select("stock_code", "company_name", "industry", "year", "report_type", "standard_name", "value")
