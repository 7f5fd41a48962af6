"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.functions.columns import amount
from finsift.functions.schema import violations
from finsift.operators import deviation, documents, guide, indicators, logic_checks, mapping, naming, peers, reasoning, report, scoring, validation
from finsift.plans import analog, incremental, stages
from finsift.plans.analog import INDICATORS, NAMES, table
from finsift.sources import config, prompts, reports
from finsift.sources.config import GROUP, PARENT
from finsift.sources.work import staged

KEY = ["stock_code", "year"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def _long(s: SparkSession, d: str) -> DataFrame:
    return mapping.statements(mapping.of_type(analog.facts(s, d), GROUP), NAMES, ("stock_code", "industry", "year"))


def _good(s: SparkSession, d: str) -> DataFrame:
    """Company-years that pass the gate; what fails it is analysed no further."""
    return validation.gate(analog.wide(s, d))[0]


def _indicators(s: SparkSession, d: str) -> DataFrame:
    return indicators.long_form(indicators.derive(_good(s, d)), INDICATORS)


def _peers(s: SparkSession, d: str) -> DataFrame:
    return peers.top_peers(peers.tag_sets(analog.tags(s, d)))


def _deviations(ind: DataFrame, s: SparkSession, d: str) -> DataFrame:
    # read by two sides of a join: written first, so that the lines are read once
    ind = staged(ind, "indicators")
    return deviation.deviations(ind, peers.peer_values(ind, _peers(s, d)))


def _found(s: SparkSession, d: str) -> DataFrame:
    return _deviations(_indicators(s, d), s, d)


def _checked(good: DataFrame) -> DataFrame:
    return logic_checks.anomalies(good, analog.parents(good))


def _anomalies(s: SparkSession, d: str) -> DataFrame:
    return _checked(staged(_good(s, d), "good"))


def _causes(outliers: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Causes by rule; what the report says and what outside facts suggest go by turns."""
    n = F.col("stock_code").cast("int") + F.col("year")
    return reasoning.rule_probabilities(
        stages.asked_about(outliers, anomalies)
        .select(*stages.KEY)
        .withColumn("path1", F.when(n % 3 == 0, "经营恶化").when(n % 3 == 1, config.NO_EXPLANATION).otherwise("战略备货"))
        .withColumn("path2", F.when(n % 2 == 0, "行业特性").otherwise("经营改善"))
        .withColumn("is_vague", n % 5 == 0)
        .withColumn("conflict", n % 7 == 0)
    )


def _analysis(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """All that scores and reports are made of.  The lines are read once; what several
    later steps read is written, as :mod:`finsift.plans.stages` does."""
    wide = staged(analog.wide(s, d), "wide")
    good, blocked = validation.gate(wide)
    out = staged(deviation.outliers(_deviations(indicators.long_form(indicators.derive(good), INDICATORS), s, d)), "outliers")
    anomalies = staged(_checked(good), "anomalies")
    return {"good": good, "blocked": blocked, "outliers": out, "anomalies": anomalies, "attribution": _causes(out, anomalies)}


def _attribution(s: SparkSession, d: str) -> DataFrame:
    return _analysis(s, d)["attribution"]


@query
def indicator_long(s, d):
    return _rounded(_indicators(s, d), "value")


@query
def indicator_pivot(s, d):
    got = report.comparison(_found(s, d), INDICATORS)
    return got.select(*KEY, *[F.round(n, 6).alias(f"i{i}") for i, n in enumerate(INDICATORS)])


@query
def growth(s, d):
    return _rounded(_indicators(s, d).where(F.col("indicator").isin("营业收入增长率", "净利润增长率")), "value").drop("industry")


@query
def peer_candidates(s, d):
    return peers.candidates(analog.companies(s, d))


@query
def peer_similarity(s, d):
    got = peers.similarity(peers.tag_sets(analog.tags(s, d)))
    return got.select("industry", F.array_join("tags_a", "|").alias("tags_a"), F.array_join("tags_b", "|").alias("tags_b"), "similarity")


@query
def peer_topk(s, d):
    return _peers(s, d)


@query
def peer_median(s, d):
    ind = _indicators(s, d)
    got = peers.peer_values(ind, _peers(s, d))
    return got.select(*KEY, "indicator", "n_peers", F.round(deviation.middle(F.col("values")), 6).alias("peer_median"))


@query
def historical_mean(s, d):
    wide = staged(analog.wide(s, d), "wide")
    bad = validation.balance(wide).where("not ok and year % 2 = 0")
    every = indicators.long_form(indicators.derive(wide), INDICATORS)
    return _rounded(peers.history(every, bad), "value", "historical_mean")


@query
def mad(s, d):
    return _rounded(_found(s, d), "mad").select(*KEY, "indicator", "mad")


@query
def deviation_multiple(s, d):
    return _rounded(_found(s, d), "actual", "median", "multiple", "signed").select(*KEY, "indicator", "actual", "median", "multiple", "signed", "zero_mad", "n_peers", "low_confidence")


@query
def deviation_graded(s, d):
    return _rounded(deviation.outliers(_found(s, d)), "multiple").select(*KEY, "indicator", "multiple", "severity")


@query
def deviation_text(s, d):
    return deviation.sentence(_found(s, d)).select(*KEY, "indicator", "summary")


@query
def numeric_parse(s, d):
    got = analog.raw_cells(s, d)
    return got.select(*KEY, "text", amount(F.col("text")).cast("double").alias("value"))


@query
def unit_convert(s, d):
    got = mapping.with_amount(analog.raw_cells(s, d))
    return got.select(*KEY, "raw_name", "unit", F.col("value").cast("double").alias("value"), "reason")


@query
def field_mapping(s, d):
    return mapping.map_names(analog.raw_cells(s, d)).select(*KEY, "raw_name", "standard_name", "statement", "priority")


@query
def unmapped_fields(s, d):
    return mapping.unmapped(analog.raw_cells(s, d))


@query
def field_priority(s, d):
    raw = analog.raw_cells(s, d)
    more = raw.where("raw_name = '营业收入'").withColumn("raw_name", F.lit("销售收入"))
    got = mapping.preferred(mapping.map_names(mapping.with_amount(raw.unionByName(more))), KEY)
    return got.select(*KEY, "standard_name", "raw_name", F.col("value").cast("double").alias("value"))


@query
def cell_fetch(s, d):
    li = table(s, d, "lineitem")
    cells = li.select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("table_id"), F.col("l_linenumber").alias("row"), F.posexplode(F.array("l_quantity", "l_discount", "l_tax")).alias("col", "cell"))
    guide = table(s, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("table_id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("row"), (F.col("o_custkey") % 3).cast("int").alias("col"), F.when(F.col("o_custkey") % 3 == 0, "end_balance").when(F.col("o_custkey") % 3 == 1, "begin_balance").otherwise("percentage").alias("role"))
    return mapping.fetch_cells(cells, guide).select("doc", "row", "col", "role", "cell")


def _period_facts(s, d):
    cells = staged(guide.grid_cells(analog.grids(s, d)), "cells")
    return guide.period_facts(cells, guide.header_guide(guide.headers(cells)))


@query
def header_roles(s, d):
    """What the guide makes of the headers alone: columns and rows of known names."""
    said = guide.headers(guide.grid_cells(analog.grids(s, d)))
    return guide.header_guide(said).where("standard_name is not null").select("doc", "table_id", "row", "col", "role", "raw_name", "standard_name", F.coalesce("field_unit", "table_unit").alias("unit"), "report_type")


@query
def grid_facts(s, d):
    got = _period_facts(s, d)
    return got.where("standard_name is not null").select(*KEY, "report_type", "standard_name", "role", F.col("value").cast("double").alias("value"), "reason")


@query
def grid_rollforward(s, d):
    """Retained earnings from one table's opening and closing columns."""
    facts = guide.statement_facts(_period_facts(s, d)).where("standard_name in ('Retained_Begin', 'Retained_End', 'Net_Profit', 'Dividends')")
    names = ["Retained_Begin", "Retained_End", "Net_Profit", "Dividends"]
    return _rounded(validation.retained(mapping.statements(facts.drop("report_type"), names)), "lhs", "rhs", "diff")


@query
def alias_suggestions(s, d):
    """Names outside the vocabulary with what they stand for, how surely, and their rows."""
    raw = analog.named_cells(s, d)
    missing = mapping.unmapped(raw)
    near = naming.suggestions(missing).select("raw_name", "standard_name", "known", F.round("confidence", 6).alias("confidence"))
    return missing.join(near, "raw_name", "left").select("raw_name", "n_rows", "standard_name", "known", "confidence")


@query
def alias_mapping(s, d):
    """The same names mapped through the aliases that are sure enough to be learned."""
    raw = analog.named_cells(s, d)
    learned = naming.suggestions(mapping.unmapped(raw), 0.8)
    return mapping.map_names(raw, learned).select("o_orderkey", "raw_name", "standard_name", "statement")


@query
def balance_check(s, d):
    return _rounded(validation.balance(analog.wide(s, d)), "lhs", "rhs", "diff")


@query
def retained_rollforward(s, d):
    return _rounded(validation.retained(analog.wide(s, d)), "lhs", "rhs", "diff")


@query
def validation_record(s, d):
    got = validation.record(staged(analog.wide(s, d), "wide")).select(*KEY, "passed", F.explode("checks").alias("c"))
    return got.select(*KEY, "passed", "c.name", F.round(F.col("c.diff").cast("double"), 6).alias("diff"), "c.ok")


@query
def blocked_union(s, d):
    good, blocked = validation.gate(_long(s, d))
    return good.select(*KEY, F.lit("ok").alias("message")).unionByName(blocked)


@query
def cash_quality(s, d):
    return logic_checks.cash_quality(_good(s, d))


@query
def cash_levels(s, d):
    return _rounded(logic_checks.cash_levels(_good(s, d)), "value")


@query
def dual_high(s, d):
    return logic_checks.dual_high(_good(s, d))


@query
def parent_gap(s, d):
    facts = staged(analog.facts(s, d), "facts")
    both = {t: mapping.statements(mapping.of_type(facts, t), n) for t, n in ((GROUP, NAMES), (PARENT, ["Monetary_Funds"]))}
    return logic_checks.parent_gap(validation.gate(both[GROUP])[0], both[PARENT])


@query
def logic_anomalies(s, d):
    return logic_checks.anomaly_names(_anomalies(s, d)).select(*KEY, F.array_join("checks", "|").alias("checks"))


@query
def anomalous_companies(s, d):
    return analog.companies(s, d).join(_anomalies(s, d), "stock_code", "left_semi").select("stock_code", "industry")


@query
def reasoning_rules(s, d):
    return _attribution(s, d).select(*KEY, "indicator", "source", F.explode("probabilities").alias("cause", "p"))


@query
def probability_check(s, d):
    p = _attribution(s, d).withColumn("probabilities", F.when(F.col("stock_code").cast("int") % 9 == 0, F.transform_values("probabilities", lambda k, v: v + 0.1)).otherwise(F.col("probabilities")))
    return p.select(*KEY, "indicator", "source", reasoning.valid_probabilities(F.col("probabilities")).alias("valid"))


@query
def attribution_line(s, d):
    return _attribution(s, d).select(*KEY, "source", reasoning.attribution_line(F.col("indicator"), F.col("probabilities")).alias("line"))


@query
def effective_weight(s, d):
    return scoring.weighted(deviation.outliers(_found(s, d))).select(*KEY, "indicator", "weight", "effective_weight")


def _impacts(f: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return scoring.deviation_impacts(f["outliers"], f["attribution"]), scoring.check_impacts(f["anomalies"], f["attribution"])


@query
def c_deduction(s, d):
    return _impacts(_analysis(s, d))[0].withColumn("expected", F.col("expected").cast("double"))


@query
def bplus_deduction(s, d):
    return _impacts(_analysis(s, d))[1]


@query
def final_score(s, d):
    f = _analysis(s, d)
    return scoring.scores(f["good"], *_impacts(f))


@query
def rescored(s, d):
    """Scores after some company-years have been changed, by scoring again only what the
    change reaches."""
    wide, key = staged(analog.wide(s, d), "wide"), ("stock_code", "industry", "year")
    changed = (F.col("number") % 10 == 3) & (F.col("year") == 1996)

    def facts(w):
        long = w.unpivot(list(key), NAMES, "standard_name", "value").withColumn("report_type", F.lit(GROUP))
        return long.unionByName(analog.parents(w).unpivot(list(key), ["Monetary_Funds"], "standard_name", "value").withColumn("report_type", F.lit(PARENT)))

    tags = analog.tags(s, d)
    old = {"facts": facts(wide), "tags": tags, "peers": staged(_peers(s, d), "peers")}
    none = s.createDataFrame([], "industry string, published date, text string")
    f = dict(old) | {"macro_facts": none}
    for name in ("statements", "gate", "indicators", "deviation", "checks", "evidence", "context", "reasoning", "scores"):
        # written is what several later steps read; what none reads is never made
        f |= {k: staged(v, k) if k in ("good", "indicators", "outliers", "anomalies", "attribution") else v for k, v in stages.STAGES[name](f, stages.How()).items()}
    other = wide.where(changed).withColumns({"Net_Profit": (F.col("Net_Profit") * 2).cast("decimal(38,4)"), "Operating_Cash_Flow": F.col("Operating_Cash_Flow") - 1000})
    return incremental.rescore(f, facts(other))["scores"]


@query
def report_rows(s, d):
    f = _analysis(s, d)
    return report.items(f["outliers"], f["anomalies"])


@query
def report_points(s, d):
    return report.points(stages.named_impacts(*_impacts(_analysis(s, d)))).select(*KEY, "side", "name")


@query
def report_json(s, d):
    """The whole report, written as JSON and read back leaf by leaf."""
    f = _analysis(s, d)
    c, b = _impacts(f)
    none = s.createDataFrame([], "stock_code string, year int, indicator string, summary string, page_number int")
    rows = report.explained(report.items(f["outliers"], f["anomalies"]), f["attribution"], none)
    made = report.assemble(scoring.scores(f["good"], c, b), rows, report.points(stages.named_impacts(c, b)), _peers(s, d), f["blocked"])
    return _rounded(report.leaves(made), "value")


@query
def section_flatten(s, d):
    turn = F.struct(F.col("role").alias("title"), F.col("text").alias("content"), F.col("turn").cast("int").alias("page_number"))
    docs = table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))).alias("a"))
    got = documents.sections(docs.select("doc", F.transform("a", lambda x: x["x"]).alias("sections")), "sections")
    return got.select("doc", "pos", "title", F.length("content").alias("size"), "page_number")


def _lines(s, d):
    return documents.lines(table(s, d, "documents").where("text is not null"), "doc_id", "text")


@query
def chunk_forward_fill(s, d):
    title = F.char_length("line").between(1, 20)
    return documents.blocks(_lines(s, d), title).select("doc", "pos", F.coalesce("block", F.lit("")).alias("block"))


@query
def table_merge(s, d):
    got = documents.tables(_lines(s, d), F.col("line").contains("|"))
    return got.groupBy("doc", "table_id").agg(F.count("*").alias("n_rows"), F.min("pos").alias("first_pos"))


@query
def table_join(s, d):
    """Orders as documents of two rows a page; some have amounts where others have texts, a
    header of their own, or a row of no table."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    # dealt by order first: its lines then stay where they are for all that follows
    li = table(s, d, "lineitem").repartition(k).groupBy(k, n).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")).alias("x")).select(k, n, "x.*")
    cell = F.when(F.col("l_returnflag") == "A", F.col("l_linestatus")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    body = F.when(F.col("l_suppkey") % 5 == 0, F.array(F.lit("a"), cell, F.lit(""))).otherwise(F.array(F.lit("a"), cell))
    cells = F.when((n - 1) % 2 == 0, F.when(k % 3 == 0, F.array(F.lit("h"), F.when(n == 5, "g").otherwise("h")))).otherwise(F.lit(None).cast("array<string>"))
    rows = li.select(k.alias("doc"), F.floor((n - 1) / 2).cast("int").alias("page"), n.cast("int").alias("pos"), F.when(F.col("l_partkey") % 11 != 0, F.coalesce(cells, body)).alias("cells"))
    return documents.joined_tables(rows).select("doc", "page", "pos", "table_id")


@query
def row_dedup(s, d):
    return documents.distinct_rows(documents.tables(_lines(s, d), F.length("line") > 0)).select("doc", "table_id", "pos")


@query
def text_cap(s, d):
    return report.too_long(_lines(s, d), "line").select("doc", "pos")


@query
def document_completeness(s, d):
    docs = table(s, d, "pages").select(F.col("page_id").alias("doc"), "html")
    has = lambda t: F.col("html").contains(t)
    return documents.completeness(docs, {"readable": F.length("html") > 0, "has_tables": has("<table"), "has_discussion": has("<article"), "has_notes": has("<footer")})


def _facts_text(s, d):
    n = F.col("event_id")
    said = F.when(n % 5 == 0, "强烈看好该公司").when(n % 5 == 1, F.lit(config.NO_FACTS)).when(n % 5 == 2, "推荐买入").otherwise(F.concat(F.lit("价格上涨 "), F.col("event_type")))
    return table(s, d, "events").select("event_id", said.alias("text"))


@query
def opinion_filter(s, d):
    return reasoning.without_opinions(_facts_text(s, d))


@query
def sentinel_null(s, d):
    return _facts_text(s, d).select("event_id", reasoning.no_sentinel(F.col("text"), config.NO_FACTS).alias("text"))


@query
def tag_violations(s, d):
    return reasoning.tag_violations(analog.tags(s, d).drop("tag"), config.soft_tags(s), config.tag_aliases(s)).select("stock_code", "dimension", "value")


@query
def relevant_sections(s, d):
    words = [("the", "毛利率"), ("of", "毛利率"), ("that", "净利率"), ("with", "资产负债率"), ("毛利率", "毛利率"), ("负债", "资产负债率")]
    turns = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    name = F.when(F.col("s_suppkey") % 2 == 0, "本期毛利率下降，").otherwise("本期资产负债率上升，")
    chinese = table(s, d, "supplier").select((-F.col("s_suppkey")).alias("key"), F.concat(name, "s_name").alias("text"))
    return reasoning.relevant_sections(turns.unionByName(chinese), words)


@query
def evidence(s, d):
    """Sentences of reports about their company's anomalies; the report says something
    on every other company's, now and then in commonplaces."""
    f = _analysis(s, d)
    asked = stages.asked_about(f["outliers"], f["anomalies"])
    n = F.col("s_suppkey")
    said = F.when(n % 3 == 0, "收入平稳。本期毛利率受多种因素影响。").otherwise("本期毛利率随产品结构变化。资产负债率因借款上升！")
    pages = table(s, d, "supplier").where("s_suppkey % 2 = 0").select(analog.code(n).alias("stock_code"), F.explode(F.sequence(F.lit(1990), F.lit(2010))).alias("year"), F.lit("管理层讨论").alias("title"), said.alias("content"), (n % 200).cast("int").alias("page_number"))
    return reasoning.evidence(asked, pages, config.keywords())


@query
def part_forward_fill(s, d):
    n = F.pmod(F.char_length("line"), F.lit(9))
    heads = F.when(n == 0, "第一节 公司简介").when(n == 1, "三、合并资产负债表").when(n == 2, "管理层讨论与分析").when(n == 3, "财务报表附注").when(n == 4, "其他事项").otherwise(F.col("line"))
    rows = _lines(s, d).withColumn("line", heads)
    return documents.parts(rows, F.col("line") != "").select("doc", "pos", F.coalesce("part", F.lit("")).alias("part"))


@query
def extracted_facts(s, d):
    n = F.col("event_id")
    raw = F.when(n % 3 == 0, F.concat(F.lit('["价格上涨 '), "event_type", F.lit('", "推荐买入", "产量持平"]'))).when(n % 3 == 1, F.concat(F.lit("1. 价格下跌 "), "event_type", F.lit("\n- 产量持平\n\n"), F.lit(config.NO_FACTS))).otherwise(F.lit(config.NO_FACTS))
    facts = table(s, d, "events").select("event_id", F.posexplode(reasoning.extract_facts(raw)).alias("pos", "fact"))
    return facts


@query
def dual_path_answers(s, d):
    """Answers of both paths and of the weighing, read by their forms."""
    n = F.col("event_id")
    look = F.when(n % 4 == 0, F.lit(config.NO_EXPLANATION)).otherwise(F.concat(F.lit('```json\n{"summary": "'), "event_type", F.lit('", "source_text": "原文", "page_number": '), (n % 90).cast("string"), F.lit(', "is_vague": '), (n % 5 == 0).cast("string"), F.lit("}\n```")))
    hyp = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"hypothesis": "战略备货", "reasoning": "r", "source": "s"}'), (n % 7).cast("int")), ","), F.lit("]"))
    p = F.concat(F.lit('{"probabilities": {"经营滞销": 0.6, "战略备货": '), F.when(n % 3 == 0, "0.4").otherwise("0.3"), F.lit(', "其他": '), F.when(n % 2 == 0, "0.1").otherwise("0.0"), F.lit("}}"))
    got = table(s, d, "events").select("event_id", reasoning.read_lookup(look).alias("l"), F.size(reasoning.read_hypotheses(hyp)).alias("n_hypotheses"), reasoning.read_probabilities(p).alias("p"))
    return got.select("event_id", "l.summary", "l.page_number", "l.is_vague", "n_hypotheses", F.col("p").isNotNull().alias("valid"), F.try_element_at("p", F.lit("战略备货")).alias("share"))


@query
def fenced_json(s, d):
    n = F.col("event_id")
    raw = F.when(n % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(n % 3 == 1, F.concat(F.lit("```\n"), F.col("props"), F.lit("```  "))).otherwise(F.col("props"))
    return table(s, d, "events").select("event_id", reasoning.parsed_response(raw, "k int")["k"].alias("k"))


@query
def prompt_render(s, d):
    got = deviation.outliers(_found(s, d))
    values = {"indicator": F.col("indicator"), "deviation": F.col("severity"), "macro_facts": F.lit("无"), "industry_tags": F.col("stock_code")}
    return got.select(*KEY, "indicator", prompts.rendered("d1_hypothesis", values).alias("prompt"))


@query
def prompt_tagging(s, d):
    """The tagging prompt of each company, with a line for each dimension of its industry."""
    tags = analog.tags(s, d)
    options = tags.groupBy("industry", "dimension").agg(F.array_sort(F.collect_set("value")).alias("options"))
    listed = options.groupBy("industry").agg(F.array_sort(F.collect_list(F.struct(F.col("dimension").alias("name"), "options"))).alias("soft_tags"))
    rows = analog.companies(s, d).join(listed, "industry")
    values = {"company_name": F.col("stock_code"), "business_description": F.when(F.col("number") % 2 == 0, F.col("industry")), "soft_tags": F.col("soft_tags")}
    return rows.select("stock_code", prompts.rendered("a1_tagging", values).alias("prompt"))


#: What the events are checked against.
EVENT = {
    "type": "object",
    "required": ["event", "k", "tags"],
    "properties": {
        "event": {"type": "string", "enum": ["click", "view", "purchase", "error"], "maxLength": 5},
        "k": {"type": "integer", "minimum": 10, "maximum": 80},
        "tags": {"type": "array", "maxItems": 3, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number", "maximum": 50}}}},
    },
}


@query
def answer_violations(s, d):
    """Each way in which the events, as JSON, miss the form they should have."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    tags = F.array_join(F.transform(F.sequence(F.lit(0), (n % 5).cast("int")), lambda i: F.concat(F.when(i % 3 == 2, '{"m": ').otherwise('{"n": '), (k.cast("int") + i).cast("string"), F.lit("}"))), ", ")
    fields = F.concat_ws(", ", F.concat(F.lit('"event": "'), "event_type", F.lit('"')), F.when(n % 4 != 1, F.concat(F.lit('"k": '), F.when(n % 4 == 2, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k))), F.concat(F.lit('"tags": ['), tags, F.lit("]")))
    raw = F.when(n % 11 == 0, F.concat(F.lit("{"), fields)).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    return table(s, d, "events").select("event_id", F.explode(violations(raw, EVENT)).alias("v")).select("event_id", "v.path", "v.fault")


@query
def llm_cache_misses(s, d):
    calls = table(s, d, "events").select(F.lit("d1_hypothesis").alias("prompt_name"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 50).cast("string")).alias("variables"))
    cached = calls.where("variables like 'click%'").select(reasoning.cache_key(F.col("prompt_name"), F.col("variables")).alias("cache_key")).distinct()
    return reasoning.cache_misses(calls, cached)


@query
def pdf_names(s, d):
    path = F.concat(F.lit("data/raw/"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("_"), F.year("o_orderdate").cast("string"), F.lit(".pdf"))
    found, year = reports.named(path)
    return table(s, d, "orders").select("o_orderkey", found.alias("stock_code"), year.alias("year"))


@query
def unprocessed_files(s, d):
    files = analog.wide(s, d).select(*KEY)
    return reports.unprocessed(files, files.where("year % 2 = 0"))


@query
def benchmark_facts(s, d):
    got = _rounded(_indicators(s, d), "value")
    return got.groupBy("industry", "year", "indicator").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query
def config_tables(s, d):
    """Each indicator's settings with the values that they weigh."""
    seen = _indicators(s, d).groupBy("indicator").agg(F.count("*").alias("n_values"), F.countDistinct("stock_code").alias("n_companies"))
    sign = F.when(F.col("direction") == "positive", 1).otherwise(-1).alias("sign")
    return config.weights(s).join(seen, "indicator", "left").select("indicator", "category", "base_weight", sign, "cap", "n_values", "n_companies")
