"""Structure of documents: sections, blocks, tables over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsift.functions.columns import amount


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, pos, line), lines numbered from 0."""
    return docs.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def sections(docs: DataFrame, column: str) -> DataFrame:
    """Rows of an array of (title, content, page_number), numbered from 0."""
    return docs.select("doc", F.posexplode(column).alias("pos", "s")).select("doc", "pos", "s.*")


def blocks(rows: DataFrame, title: Column) -> DataFrame:
    """``rows`` (doc, pos, line) with the title of the block each is in: the last
    line before it, or itself, that ``title`` holds for."""
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block", F.last(F.when(title, F.col("line")), ignorenulls=True).over(before))


#: The four parts of a report with the headings that open them.
PARTS = (
    ("financial_data", "资产负债表|利润表|损益表|现金流量表|财务报表$"),
    ("footnotes", "附注|报表项目注释"),
    ("management_discussion", "管理层讨论|经营情况讨论|董事会报告|经营情况的讨论"),
    ("company_overview", "公司简介|公司概况|公司业务概要|主要业务"),
)


def part_of(title: Column) -> Column:
    """The part of a report that a heading opens, or null; notes to a statement are
    notes."""
    name = F.regexp_replace(title, r"\s", "")
    found = F.when(name.rlike(PARTS[1][1]), PARTS[1][0])
    for part, form in (PARTS[0], *PARTS[2:]):
        found = found.when(name.rlike(form), part)
    return found


def parts(rows: DataFrame, title: Column) -> DataFrame:
    """``rows`` (doc, pos, line) with the part of the report each is in: that of the
    last heading of a part at or before it; other headings don't end a part."""
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(title, part_of(F.col("line")))
    return rows.withColumn("part", F.last(opened, ignorenulls=True).over(before))


def tables(rows: DataFrame, in_table: Column, heads: Column | None = None) -> DataFrame:
    """Rows of tables with table_id, from 1 in a document: a table goes on over page
    breaks until a row that isn't in one, or, where ``heads`` marks header rows, a
    header other than the table's own."""
    order = Window.partitionBy("doc").orderBy("pos")
    marked = rows.withColumn("__in", in_table)
    new = F.col("__in") & ~F.coalesce(F.lag("__in").over(order), F.lit(False))
    if heads is not None:
        marked = marked.withColumn("__head", F.when(heads, F.col("line")))
        past = F.last("__head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = new | (F.col("__head").isNotNull() & ~F.col("__head").eqNullSafe(past))
    marked = marked.withColumn("__new", new).withColumn("table_id", F.sum(F.col("__new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.where("__in").select("doc", "pos", "line", "table_id")


def kind_of(cell: Column) -> Column:
    """Whether a cell is an amount (n), text (t) or empty (-)."""
    return F.when(F.coalesce(F.trim(cell), F.lit("")) == "", "-").when(amount(cell).isNotNull(), "n").otherwise("t")


def joined_tables(rows: DataFrame) -> DataFrame:
    """``rows`` (doc, page, pos, cells; cells null for a row of no table) of tables with
    table_id, from 1 in a document: parts of a table on neighbouring pages are joined.

    A part is a run of table rows on one page.  The first of a page goes on the last of the
    page before if nothing but the page's end is between them and they agree: in the number
    of columns (the most that a row has), in each column's kind (amounts or texts, where
    both parts have some), and in the header, if the part begins with one (a row of texts
    alone): it repeats the table's.  Other parts begin a table, so two tables that meet at
    the end of a page stay apart.

    Rows are dealt by document once, and sorted twice; parts are windows over them, and no
    row is joined with what was made of it.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    # n, t or - for each cell, in one string: read once, compared often
    marked = rows.where("doc is not null").withColumn("__kinds", F.array_join(F.transform("cells", kind_of), ""))
    marked = marked.withColumn("__in", F.col("cells").isNotNull())
    before = F.coalesce(F.lag("__in").over(order), F.lit(False))
    turned = F.lag("page").over(order) != F.col("page")
    # a part that stands first on its page, right after a row of the page before
    touches = before & (F.lag("page").over(order) == F.col("page") - 1)
    begun = marked.withColumns({"__start": F.col("__in") & (~before | turned), "__touches": touches})
    headed = F.col("__start") & F.contains("__kinds", F.lit("t")) & ~F.contains("__kinds", F.lit("n"))
    parts_ = begun.withColumn("__part", F.sum(F.col("__start").cast("int")).over(order)).where("__in").withColumn("__headed", headed)

    # rows of a part differ little in their kinds; the header's don't count
    whole = Window.partitionBy("doc", "__part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = parts_.withColumns({"__width": F.max(F.size("cells")).over(whole), "__forms": F.collect_set(F.when(~F.col("__headed"), F.col("__kinds"))).over(whole)})

    # a part's first row comes right after the last of the part before
    along = Window.partitionBy("doc").orderBy("__part", "pos")
    title = F.array_join(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), "|")
    past = told.withColumn("__head", F.when(F.col("__headed"), title))
    past = past.withColumns({f"{c}0": F.lag(c).over(along) for c in ("__width", "__forms")})
    # the header of the table that goes on: that of the last part which had one
    past = past.withColumn("__head0", F.last("__head", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    # a column's kind counts where all its cells that aren't empty are of one
    has = lambda forms, col, kind: F.exists(forms, lambda k: F.substring(k, col, F.lit(1)) == kind)
    only = lambda forms, col, kind, other: has(forms, col, kind) & ~has(forms, col, other)
    differs = lambda c: (only("__forms", c, "n", "t") & only("__forms0", c, "t", "n")) | (only("__forms", c, "t", "n") & only("__forms0", c, "n", "t"))
    unlike = F.when(F.col("__width") > 0, F.exists(F.sequence(F.lit(1), F.col("__width")), differs))
    repeats = F.col("__head").isNull() | (F.col("__head") == F.col("__head0"))
    goes_on = F.when(F.col("__start") & F.col("__touches") & (F.col("__width") == F.col("__width0")) & repeats, ~F.coalesce(unlike, F.lit(False)))
    begins = F.col("__start") & ~F.coalesce(goes_on, F.lit(False))
    numbered = past.withColumn("__begins", begins.cast("int")).withColumn("table_id", F.sum("__begins").over(along).cast("int"))
    return numbered.select("doc", "page", "pos", "cells", "table_id")


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Table rows without those that an earlier one of the table repeats."""
    return rows.groupBy("doc", "table_id", "line").agg(F.min("pos").alias("pos"))


def completeness(docs: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Which parts each document has, and whether it has all."""
    out = docs.select("doc", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in parts.items()])
    whole = F.lit(True)
    for n in parts:
        whole = whole & F.col(n)
    return out.withColumn("complete", whole)
