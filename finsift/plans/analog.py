"""Statements of companies, made from the star schema: a supplier is a company, its
nation the industry and the year of shipment the fiscal year.  The engine reads any
frames with these columns; this is what the driver's tables can stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.sources.config import GROUP, PARENT
from finsift.sources.work import staged

NAMES = ["Revenue_Total", "Cost_Revenue", "Gross_Profit", "Net_Profit", "Total_Assets", "Total_Liabilities", "Equity_Total", "Monetary_Funds", "Operating_Cash_Flow", "Operating_Cash_Inflow", "Interest_Debt", "Retained_Begin", "Retained_End", "Dividends", "Inventory", "Receivables", "Current_Assets", "Current_Liabilities"]
INDICATORS = ["毛利率", "净利率", "资产负债率", "营业收入增长率", "净利润增长率", "存货周转率", "应收账款周转率", "流动比率"]
_D = "decimal(18,4)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def code(key):
    return F.lpad(key.cast("string"), 6, "0")


def wide(spark: SparkSession, d: str) -> DataFrame:
    """Statements side by side: one pass over the lines, summed as decimals, so that
    sums don't depend on their order."""
    li = table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    sums = li.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.sum((price * (1 - F.col("l_discount"))).cast(_D)).alias("revenue"),
        F.sum(price.cast(_D)).alias("gross"),
        F.sum((price * F.col("l_tax") * 5).cast(_D)).alias("cost"),
        F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0.0).cast(_D)).alias("returned"),
        F.sum(F.when(F.col("l_linestatus") == "F", price).otherwise(0.0).cast(_D)).alias("closed"),
        F.sum(F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), price).otherwise(0.0).cast(_D)).alias("parent_closed"),
    )
    both = sums.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    odd = F.when(F.col("l_suppkey") % 7 == 0, 5).otherwise(0)
    c = F.col
    amounts = {
        "Revenue_Total": c("revenue"),
        "Cost_Revenue": c("cost"),
        "Gross_Profit": c("revenue") - c("cost"),
        "Net_Profit": c("revenue") - c("cost") - c("returned"),
        "Total_Assets": c("gross") * 2,
        "Total_Liabilities": c("returned") + c("cost"),
        "Equity_Total": c("gross") * 2 - c("returned") - c("cost") + odd,
        "Monetary_Funds": c("closed"),
        "Operating_Cash_Flow": c("revenue") - c("cost") - c("returned") * 2,
        "Operating_Cash_Inflow": c("gross") - c("returned") * 2,
        "Interest_Debt": c("returned") * 2,
        "Retained_Begin": c("revenue"),
        "Retained_End": c("revenue") * 2 - c("cost") * 2 - c("returned") + odd * 1000,
        "Dividends": c("cost"),
        "Inventory": c("returned"),
        "Receivables": c("gross") - c("closed"),
        "Current_Assets": c("gross") + c("closed"),
        "Current_Liabilities": c("returned") + c("closed"),
    }
    out = both.select(code(c("l_suppkey")).alias("stock_code"), c("s_nationkey").cast("string").alias("industry"), "year", *[v.cast("decimal(38,4)").alias(n) for n, v in amounts.items()], c("parent_closed").cast("decimal(38,4)").alias("parent_funds"), c("l_suppkey").alias("number"))
    return out


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Long facts of both report types; every fourth company has no parent report."""
    w = staged(wide(spark, d), "wide")
    long = w.unpivot(["stock_code", "industry", "year"], NAMES, "standard_name", "value").withColumn("report_type", F.lit(GROUP))
    parent = parents(w).unpivot(["stock_code", "industry", "year"], ["Monetary_Funds"], "standard_name", "value").withColumn("report_type", F.lit(PARENT))
    return long.unionByName(parent)


def parents(w: DataFrame) -> DataFrame:
    """Parent reports beside the group's: funds alone."""
    return w.where("number % 4 <> 0").select("stock_code", "industry", "year", F.col("parent_funds").alias("Monetary_Funds"))


def raw_cells(spark: SparkSession, d: str) -> DataFrame:
    """Recognised text: names by turn from the vocabulary, units by turn, negative
    amounts in brackets, an unreadable amount and an unknown unit now and then."""
    names = {"Revenue_Total": ("营业收入", "营业总收入", "营收 "), "Net_Profit": ("净利润", "归母净利润", "盈利"), "Total_Assets": ("资产总计", "总资产", "资产总计")}
    w, n = wide(spark, d), F.col("number")
    cells = []
    for field, forms in names.items():
        value = F.col(field)
        raw = F.when(n % 3 == 0, forms[0]).when(n % 3 == 1, forms[1]).otherwise(forms[2])
        text = F.when(n % 13 == 5, "—").when(value < 0, F.concat(F.lit("("), F.abs(value).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(" "), value.cast("string")))
        cells.append(F.struct(raw.alias("raw_name"), text.alias("text")))
    units = [F.when(n % 4 == 0, "元").when(n % 4 == 1, "千元").when(n % 4 == 2, "万元").otherwise("美元").alias("table_unit"), F.when(n % 5 == 0, "元").alias("field_unit")]
    return w.select("stock_code", "year", *units, F.inline(F.array(*cells))).select("stock_code", "year", "raw_name", "text", "table_unit", "field_unit")


def grids(spark: SparkSession, d: str) -> DataFrame:
    """Extracted documents with a balance sheet and an income statement as grids: opening
    balances before closing ones or after, notes between, units above the table, in a
    name or with the document, an unreadable amount now and then."""
    n, c = F.col("number"), F.col
    cents = lambda x: F.format_number(F.abs(x).cast("decimal(30,2)"), 2)
    say = lambda x: F.when(x < 0, F.concat(F.lit("("), cents(x), F.lit(")"))).otherwise(cents(x))
    end, begin, note = F.when(n % 2 == 0, "期末余额").otherwise(" 期末数"), F.lit("期初余额"), F.lit("附注")

    def row(name, first, second):
        ordered = F.when(n % 3 == 0, F.array(name, F.lit("七、1"), say(first), say(second)))
        return ordered.otherwise(F.array(name, say(second), F.lit("注"), say(first)))

    head = F.when(n % 3 == 0, F.array(F.lit("项目"), note, end, begin)).otherwise(F.array(F.lit("项目"), begin, note, end))
    top = F.array(F.when(n % 5 == 0, "单位：千元 币种：人民币").otherwise("编制单位"))
    broken = F.when(n % 13 == 5, F.array(F.lit("负债合计"), F.lit("—"), F.lit("—"), F.lit("—"))).otherwise(row(F.lit("负债合计"), c("Total_Liabilities"), c("Total_Assets")))
    sheet = F.array(top, head, row(F.lit("资产总计"), c("Total_Assets"), c("Total_Liabilities")), broken, row(F.lit("一、未分配利润（元）"), c("Retained_End"), c("Retained_Begin")), F.array(F.lit("审计师：甲")))
    flows = F.array(F.array(F.lit("项目"), F.concat(c("year").cast("string"), F.lit("年度")), F.concat((c("year") - 1).cast("string"), F.lit("年度"))), F.array(F.lit("净利润"), say(c("Net_Profit")), say(c("Revenue_Total"))), F.array(F.lit("利润分配"), say(c("Dividends")), F.lit("")))
    grid = lambda i, title, rows: F.struct(F.lit(i).alias("table_id"), title.alias("title"), F.lit(None).cast("string").alias("unit"), F.lit(9).alias("page_number"), rows.alias("rows"))
    title = F.when(n % 4 == 1, "母公司资产负债表").otherwise("合并资产负债表")
    meta = F.create_map(F.lit("unit"), F.when(n % 7 == 3, "万元").otherwise("元"))
    return wide(spark, d).select("stock_code", "year", meta.alias("metadata"), F.struct(c("industry").alias("industry_classification")).alias("company_overview"), F.array(grid(0, title, sheet), grid(1, F.lit("利润表"), flows)).alias("grids"))


#: Names as reports write them: known ones edited, and others that are near them in letters only.
VARIANTS = (
    "营业 收入", "一、营业总收入", "营业总收人", "主营业务收入净额", "减：营业成本", "营业成本（元）", "归属母公司股东的净利润", "归属于母公司股东净利润", "扣非后净利润", "净利润率",
    "资产总計", "非流动资产合计", "流动资产合计", "流动负债小计", "负债合計", "股东权益合计额", "所有者权益总计", "货币资金余额", "经营活动产生的现金流量净額", "经营活动现金流入净额",
    "销售商品、提供劳务收到现金", "应收帐款", "其他应收账款", "存货净额", "有息负责", "期未未分配利润", "期初未分配利润", "商誉", "研发费用", "利润分配表",
)


def named_cells(spark: SparkSession, d: str) -> DataFrame:
    """A name of VARIANTS for each order."""
    names = F.array(*[F.lit(v) for v in VARIANTS])
    return table(spark, d, "orders").select("o_orderkey", F.get(names, (F.col("o_custkey") % len(VARIANTS)).cast("int")).alias("raw_name"))


def companies(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(code(F.col("s_suppkey")).alias("stock_code"), F.col("s_nationkey").cast("string").alias("industry"), F.col("s_suppkey").alias("number"), "s_acctbal")


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Soft tags in long form, by fixed cut points; some are no option, some another spelling."""
    n, a = F.col("number"), F.col("s_acctbal")
    values = {
        "资产结构": F.when(a < 0, "轻资产").when(a < 5000, "混合").otherwise("重资产"),
        "客户类型": F.when(n % 3 == 0, "To-B").when(n % 3 == 1, "To-C端").otherwise("To-G"),
        "生命周期": F.when(n % 11 == 0, "未知").when(n % 2 == 0, "成熟期").otherwise("成长期"),
    }
    out = None
    for dim, v in values.items():
        rows = companies(spark, d).select("stock_code", "industry", F.lit(dim).alias("dimension"), v.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("tag", F.concat_ws(":", "dimension", "value"))
