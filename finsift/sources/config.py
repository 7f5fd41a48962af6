"""Domain tables as data: the vocabulary, indicators, thresholds and tags."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Standard fields, their statement and the names reports use, in order of preference.
FIELDS = (
    ("Revenue_Total", "profit_loss", ("营业收入", "营业总收入", "主营业务收入", "营收", "销售收入")),
    ("Cost_Revenue", "profit_loss", ("营业成本", "主营业务成本")),
    ("Gross_Profit", "profit_loss", ("毛利润", "毛利")),
    ("Net_Profit", "profit_loss", ("净利润", "归母净利润", "归属于母公司股东的净利润", "扣非净利润")),
    ("Total_Assets", "balance_sheet", ("资产总计", "总资产", "资产总额")),
    ("Total_Liabilities", "balance_sheet", ("负债合计", "总负债", "负债总额", "负债总计")),
    ("Equity_Total", "balance_sheet", ("所有者权益合计", "股东权益合计", "净资产合计", "归属于母公司所有者权益合计")),
    ("Monetary_Funds", "balance_sheet", ("货币资金", "货币资金期末余额")),
    ("Operating_Cash_Flow", "cashflow", ("经营活动产生的现金流量净额", "经营活动现金流量净额", "经营现金流净额")),
    ("Operating_Cash_Inflow", "cashflow", ("销售商品、提供劳务收到的现金", "销售商品收到的现金")),
    # our additions, for checks and indicators that the ten fields above leave out
    ("Interest_Debt", "balance_sheet", ("有息负债",)),
    ("Retained_Begin", "balance_sheet", ("期初未分配利润",)),
    ("Retained_End", "balance_sheet", ("期末未分配利润", "未分配利润")),
    ("Dividends", "profit_loss", ("利润分配",)),
    ("Inventory", "balance_sheet", ("存货",)),
    ("Receivables", "balance_sheet", ("应收账款",)),
    ("Current_Assets", "balance_sheet", ("流动资产合计",)),
    ("Current_Liabilities", "balance_sheet", ("流动负债合计",)),
)
# Indicator, category, base weight, direction, amplification cap.
INDICATORS = (
    ("存货周转率", "营运能力", -1.0, "negative", 3.0),
    ("应收账款周转率", "营运能力", -1.0, "negative", 3.0),
    ("毛利率", "盈利能力", 1.0, "positive", 2.0),
    ("净利率", "盈利能力", 1.0, "positive", 2.0),
    ("资产负债率", "偿债能力", -1.0, "negative", 2.5),
    ("流动比率", "偿债能力", 1.0, "positive", 2.0),
    ("营业收入增长率", "成长能力", 1.0, "positive", 3.0),
    ("净利润增长率", "成长能力", 1.0, "positive", 3.0),
)
#: Indicators that are a field over another, and those that are a field's growth.
RATIOS = {
    "存货周转率": ("Cost_Revenue", "Inventory"),
    "应收账款周转率": ("Revenue_Total", "Receivables"),
    "毛利率": ("Gross_Profit", "Revenue_Total"),
    "净利率": ("Net_Profit", "Revenue_Total"),
    "资产负债率": ("Total_Liabilities", "Total_Assets"),
    "流动比率": ("Current_Assets", "Current_Liabilities"),
}
GROWTHS = {"营业收入增长率": "Revenue_Total", "净利润增长率": "Net_Profit"}
# Thresholds of the internal checks and of the peer deviation.
CASH_NORMAL, BOTH_HIGH = 0.6, 0.3
# Normal range and severe threshold of the two cash ratios.
CASH_TO_PROFIT, CASH_TO_REVENUE = (0.6, 2.0, 0.0), (0.6, 1.5, 0.3)
GAP_SEVERE, GAP_WARNING = 0.3, 0.15
ABNORMAL, EXTREME = 2.0, 5.0
# Units of amounts in yuan.
UNITS = (("元", 1), ("千元", 1000), ("万元", 10000))
# Our own: what headers call the periods of columns, fields with an opening name of their
# own, words that change a name's meaning, and those of them that a name can't lack either.
PERIODS = (
    ("end_balance", ("期末余额", "期末数", "期末", "年末余额", "年末数", "本期期末")),
    ("begin_balance", ("期初余额", "期初数", "期初", "年初余额", "年初数", "上年年末余额", "上年期末")),
    ("year", ("本期金额", "本期发生额", "本期数", "本期", "本年金额", "本年累计数", "本年度")),
    ("previous_year", ("上期金额", "上期发生额", "上期数", "上期", "上年金额", "上年同期", "上年度")),
)
OPENINGS = (("Retained_End", "Retained_Begin"),)
QUALIFIERS = ("非", "外", "率", "期初", "期末", "少数", "流动", "资产", "负债", "权益", "收入", "成本", "增加", "减少", "流入", "流出", "投资", "筹资", "其他", "小计")
MARKERS = ("非", "期初", "期末", "少数", "流动", "流入", "其他")
# Soft tag dimensions and their options, and other spellings of options.
SOFT_TAGS = (
    ("资产结构", ("重资产", "轻资产", "混合")),
    ("毛利率水平", ("高毛利", "中等毛利", "低毛利")),
    ("客户类型", ("To-B", "To-C", "To-G")),
    ("竞争壁垒", ("品牌护城河", "技术壁垒", "规模效应", "特许经营", "无明显壁垒")),
    ("现金流特征", ("奶牛型", "烧钱型", "平衡型")),
    ("生命周期", ("初创期", "成长期", "成熟期", "衰退期")),
)
TAG_ALIASES = (("To-C端", "To-C"), ("To-B端", "To-B"), ("依靠品牌护城河", "品牌护城河"))
# Weights of causes, and the phrases that mark an opinion or no finding.
CAUSES = (("财务舞弊", -3.0), ("经营恶化", -1.0), ("经营改善", 1.0), ("行业特性", 0.0))
OPINIONS = ("强烈看好", "强烈卖出", "推荐买入")
# Words by which a report speaks of a check.
KEYWORDS = [(w, "净现比/收现比") for w in ("经营活动现金流", "收现")] + [(w, "存贷双高") for w in ("货币资金", "有息负债", "短期借款")] + [("母公司", "母子资金分离度")]
NO_FACTS, NO_EXPLANATION = "未找到客观数据", "无直接解释"
BLOCKED = "【系统异常阻断：PDF数据源损坏或低劣造假，请人工核验原文件】"
GROUP, PARENT = "合并报表", "母公司报表"


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as part of the plan: joins know its size and need no Python."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    columns = [c.split() for c in schema.split(", ")]
    values = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)]
    return spark.createDataFrame(pa.table(values, names=[name for name, _ in columns]), schema)


def indicator_names() -> list[str]:
    return [n[0] for n in INDICATORS]


def standard_names() -> list[str]:
    return [f[0] for f in FIELDS]


def keywords() -> list[tuple[str, str]]:
    """Words by which a report speaks of an indicator, its own name first, or of a check."""
    return [(n, n) for n in indicator_names()] + KEYWORDS


def fields(spark: SparkSession) -> DataFrame:
    """(raw_name, standard_name, statement, priority), one row for each name."""
    rows = [(v, f, s, i) for f, s, names in FIELDS for i, v in enumerate(names)]
    return listed(spark, rows, "raw_name string, standard_name string, statement string, priority int")


def weights(spark: SparkSession) -> DataFrame:
    return listed(spark, list(INDICATORS), "indicator string, category string, base_weight double, direction string, cap double")


def units(spark: SparkSession) -> DataFrame:
    return listed(spark, list(UNITS), "unit string, factor int")


def soft_tags(spark: SparkSession) -> DataFrame:
    return listed(spark, [(d, o) for d, options in SOFT_TAGS for o in options], "dimension string, value string")


def tag_aliases(spark: SparkSession) -> DataFrame:
    return listed(spark, list(TAG_ALIASES), "alias string, value string")


def causes(spark: SparkSession) -> DataFrame:
    return listed(spark, list(CAUSES), "cause string, cause_weight double")
