"""Operators on small frames: the documented examples, the decisions on open points
and the properties that hold for any input."""

from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finsift.functions.columns import amount, clamp, fenced, middle, ratio, spread
from finsift.operators import deviation, documents, indicators, logic_checks, mapping, peers, reasoning, report, scoring, validation
from finsift.sources import config, prompts, reports

KEY = "stock_code string, year int"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_mad_of_the_documented_sample(spark):
    values = F.array(*[F.lit(float(v)) for v in (10, 12, 11, 13, 100)])
    assert one(spark, spread(values)) == 1.0 and one(spark, middle(values)) == 12.0


def test_median_of_none_and_of_an_even_number(spark):
    assert one(spark, middle(F.array().cast("array<double>"))) is None
    assert one(spark, middle(F.array(F.lit(1.0), F.lit(4.0)))) == 2.5


@pytest.mark.parametrize(
    ("text", "value"),
    [("1,234.5", "1234.5000"), ("（1，000）", "-1000.0000"), (" 12 ", "12.0000"), ("—", None), ("", None), (None, None), ("１２．５", "12.5000"), ("-3", "-3.0000")],
)
def test_amounts_from_text(spark, text, value):
    got = one(spark, amount(F.lit(text).cast("string")))
    assert got == (None if value is None else Decimal(value))


def test_ratio_and_clamp_keep_what_is_undefined(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, clamp(F.lit(None).cast("double"), 0.0, 5.0)) is None
    assert one(spark, clamp(F.lit(9.0), 0.0, 5.0)) == 5.0


def test_units_and_override(spark):
    raw = spark.createDataFrame([("1", "万元", None), ("1", "万元", "元"), ("1", "美元", None), ("x", "元", None)], "text string, table_unit string, field_unit string")
    got = [(r["value"], r["reason"]) for r in mapping.with_amount(raw).orderBy("text", "unit").collect()]
    assert sorted(got, key=str) == sorted([(Decimal("10000.0000"), None), (Decimal("1.0000"), None), (None, "unit"), (None, "text")], key=str)


def test_names_map_trimmed_and_best_priority_wins(spark):
    raw = spark.createDataFrame([("a", " 营收 ", 1.0), ("a", "营业收入", 2.0), ("a", "无此项", 3.0)], "doc string, raw_name string, value double")
    mapped = mapping.map_names(raw)
    assert mapped.where("standard_name is null").count() == 1
    assert mapping.preferred(mapped, ["doc"]).first()["value"] == 2.0
    assert [r["raw_name"] for r in mapping.unmapped(raw).collect()] == ["无此项"]


def sheet(spark, **amounts):
    names = ["Total_Assets", "Total_Liabilities", "Equity_Total", "Retained_Begin", "Retained_End", "Net_Profit", "Dividends"]
    row = ["000001", 2024, *[None if amounts.get(n) is None else Decimal(amounts[n]) for n in names]]
    return spark.createDataFrame([row], f"{KEY}, " + ", ".join(f"{n} decimal(38,4)" for n in names))


def test_balance_and_gate(spark):
    good = sheet(spark, Total_Assets=100, Total_Liabilities=60, Equity_Total=40)
    bad = sheet(spark, Total_Assets=100, Total_Liabilities=60, Equity_Total=45)
    missing = sheet(spark, Total_Assets=100)
    assert validation.balance(good).first()["ok"] is True
    assert validation.balance(bad).first()["ok"] is False
    assert validation.balance(missing).first()["ok"] is None
    assert validation.gate(bad)[1].first()["message"] == config.BLOCKED and validation.gate(bad)[0].count() == 0
    assert validation.gate(missing)[0].count() == 1
    assert validation.record(bad).first()["passed"] is False and validation.record(missing).first()["passed"] is True


def test_retained_roll_forward(spark):
    assert validation.retained(sheet(spark, Retained_Begin=10, Net_Profit=5, Dividends=2, Retained_End=13)).first()["ok"] is True
    assert validation.retained(sheet(spark, Retained_Begin=10, Net_Profit=5, Dividends=2, Retained_End=14)).first()["ok"] is False
    assert validation.retained(sheet(spark, Retained_Begin=0, Net_Profit=0, Dividends=0, Retained_End=0)).first()["ok"] is True


def wide(spark, rows):
    names = ["Net_Profit", "Operating_Cash_Flow", "Operating_Cash_Inflow", "Revenue_Total", "Monetary_Funds", "Total_Assets", "Interest_Debt"]
    return spark.createDataFrame([("000001", 2020 + i, *[None if v is None else float(v) for v in r]) for i, r in enumerate(rows)], f"{KEY}, " + ", ".join(f"{n} double" for n in names))


def test_cash_quality(spark):
    w = wide(spark, [(100, 40, 50, 100, 0, 1, 0), (100, -50, 50, 100, 0, 1, 0), (-100, 50, 50, 100, 0, 1, 0), (100, 40, 90, 100, 0, 1, 0), (100, 40, 50, 0, 0, 1, 0)])
    got = {r["year"]: r["severity"] for r in logic_checks.cash_quality(w).collect()}
    assert got == {2020: 2.0, 2021: 5.0}


def test_dual_high_and_parent_gap(spark):
    w = wide(spark, [(1, 1, 1, 1, 60, 100, 60), (1, 1, 1, 1, 40, 100, 40), (1, 1, 1, 1, 31, 100, 31), (1, 1, 1, 1, 30, 100, 60)])
    got = {r["year"]: r["severity"] for r in logic_checks.dual_high(w).collect()}
    assert got == {2020: 5.0, 2021: 2.3, 2022: 1.0}
    parent = w.where("year <> 2023").select("stock_code", "year", (F.col("Monetary_Funds") - (F.col("year") - 2019) * 16).alias("Monetary_Funds"))
    assert {r["year"]: r["severity"] for r in logic_checks.parent_gap(w, parent).collect()} == {2020: 3.0, 2021: 5.0, 2022: 5.0}
    assert logic_checks.anomaly_names(logic_checks.anomalies(w, parent)).where("year = 2020").first()["checks"] == sorted([logic_checks.HIGH, logic_checks.GAP])


@given(a=st.floats(-10, 10), b=st.floats(-10, 10))
def test_cash_severity_falls_as_the_ratio_rises(a, b):
    def plain(r):
        return 5.0 if r < 0 else max(0.0, min(5.0, (0.6 - r) / 0.2 * 2))

    low, high = sorted((a, b))
    assert plain(low) >= plain(high) and 0 <= plain(a) <= 5


def tags(spark, rows):
    return spark.createDataFrame([(c, i, t) for c, i, ts in rows for t in ts], "stock_code string, industry string, tag string")


def test_peers_by_tags_never_self_ties_by_code(spark):
    rows = [(f"{n:06d}", "白酒", ["a", "b"] if n % 2 else ["b", "c"]) for n in range(20)] + [("900000", "银行", ["a"])]
    got = {}
    for r in peers.top_peers(peers.tag_sets(tags(spark, rows))).orderBy("stock_code", "rank").collect():
        got.setdefault(r["stock_code"], []).append(r["peer_code"])
    assert got["000001"] == ["000003", "000005", "000007", "000009", "000011"]
    assert got["000003"] == ["000001", "000005", "000007", "000009", "000011"]
    assert "900000" not in got and all(c not in p for c, p in got.items())


def test_peers_match_all_pairs(spark):
    rows = [(f"{n:06d}", str(n % 2), [f"x{n % 3}", f"y{n % 5}", f"z{n % 4}"]) for n in range(60)]
    sets = {c: (i, set(t)) for c, i, t in rows}
    got = {}
    for r in peers.top_peers(peers.tag_sets(tags(spark, rows))).orderBy("stock_code", "rank").collect():
        got.setdefault(r["stock_code"], []).append(r["peer_code"])
    for c, (i, t) in sets.items():
        other = sorted((-len(t & u) / 3, d) for d, (j, u) in sets.items() if j == i and d != c)
        assert got[c] == [d for _, d in other[:5]]


def test_deviation_with_and_without_spread(spark):
    ind = spark.createDataFrame([("a", 2024, "毛利率", 20.0), ("b", 2024, "毛利率", 5.0), ("c", 2024, "毛利率", 5.0)], f"{KEY}, indicator string, value double")
    values = spark.createDataFrame([("a", 2024, "毛利率", [10.0, 12.0, 11.0, 13.0, 100.0], 5), ("b", 2024, "毛利率", [5.0, 5.0], 2), ("c", 2024, "毛利率", [4.0], 1)], f"{KEY}, indicator string, values array<double>, n_peers int")
    got = {r["stock_code"]: r for r in deviation.sentence(deviation.deviations(ind, values)).collect()}
    assert (got["a"]["multiple"], got["a"]["severity"], got["a"]["low_confidence"]) == (8.0, "extreme", False)
    assert got["a"]["summary"] == "高于同行中位数 8.0倍 MAD"
    assert (got["b"]["multiple"], got["b"]["zero_mad"], got["b"]["severity"]) == (0.0, False, "normal")
    assert (got["c"]["multiple"], got["c"]["zero_mad"], got["c"]["severity"], got["c"]["low_confidence"]) == (None, True, "extreme", True)


def test_history_leaves_out_bad_years_and_minds_gaps(spark):
    ind = spark.createDataFrame([("a", y, "毛利率", float(y - 2000)) for y in (2010, 2016, 2017, 2018, 2020)], f"{KEY}, indicator string, value double")
    bad = spark.createDataFrame([("a", 2017)], KEY)
    got = {r["year"]: (r["historical_mean"], r["n_years"]) for r in peers.history(ind, bad).collect()}
    assert got[2020] == (17.0, 2) and got[2016] == (None, 0)


def test_growth_needs_the_year_before(spark):
    rows = [("a", "x", 2018, 100.0), ("a", "x", 2019, 150.0), ("a", "x", 2021, 100.0)]
    w = spark.createDataFrame(rows, "stock_code string, industry string, year int, Revenue_Total double").withColumn("Net_Profit", -F.col("Revenue_Total"))
    d = {r["year"]: r for r in indicators.derive(w.withColumn("Gross_Profit", F.lit(1.0)).withColumn("Total_Liabilities", F.lit(1.0)).withColumn("Total_Assets", F.lit(0.0))).collect()}
    assert d[2019]["营业收入增长率"] == 0.5 and d[2021]["营业收入增长率"] is None and d[2019]["净利润增长率"] is None and d[2018]["资产负债率"] is None


def scored(spark, multiple, above, p, indicator="资产负债率"):
    found = spark.createDataFrame([("a", 2024, indicator, multiple, above, False)], f"{KEY}, indicator string, multiple double, above boolean, zero_mad boolean")
    causes = spark.createDataFrame([("a", 2024, indicator, "C", p)], f"{KEY}, indicator string, source string, probabilities map<string,double>")
    impacts = scoring.deviation_impacts(found, causes)
    none = spark.createDataFrame([], f"{KEY}, check_name string, impact double")
    return impacts.first(), scoring.scores(found, impacts, none).first()


def test_the_worked_score(spark):
    impact, score = scored(spark, 3.2, True, {"经营滞销": 0.6, "战略备货": 0.3, "其他": 0.1})
    assert abs(impact["impact"] + 6.61333) < 1e-4 and abs(score["final_score"] - 93.38667) < 1e-4 and score["tier"] == "high"


def test_cause_class_side_and_cap_count(spark):
    assert scored(spark, 3.0, True, {"财务舞弊": 1.0})[0]["impact"] == -18.0
    assert scored(spark, 3.0, True, {"行业特性": 1.0})[0]["impact"] == 0.0
    assert scored(spark, 3.0, False, {"其他": 1.0})[0]["impact"] == 6.0
    assert scored(spark, 30.0, True, {"其他": 1.0})[0]["impact"] == -75.0


def test_no_anomalies_give_100_and_scores_stay_in_bounds(spark):
    keys = spark.createDataFrame([("a", 2024), ("b", 2024)], KEY)
    dev = spark.createDataFrame([("b", 2024, -500.0)], f"{KEY}, impact double")
    none = spark.createDataFrame([], f"{KEY}, impact double")
    got = {r["stock_code"]: (r["final_score"], r["tier"]) for r in scoring.scores(keys, dev, none).collect()}
    assert got == {"a": (100.0, "high"), "b": (0.0, "low")}
    assert {r["stock_code"]: r["final_score"] for r in scoring.scores(keys, dev.withColumn("impact", F.lit(50.0)), none).collect()} == {"a": 100.0, "b": 100.0}


def test_check_impacts_by_cause(spark):
    found = spark.createDataFrame([("a", 2024, "存贷双高", 5.0), ("b", 2024, "存贷双高", 5.0), ("c", 2024, "存贷双高", 5.0)], f"{KEY}, check_name string, severity double")
    causes = spark.createDataFrame([("a", 2024, "存贷双高", "B+", {"行业特性": 1.0}), ("b", 2024, "存贷双高", "B+", {"行业特性": 0.5, "财务舞弊": 0.5})], f"{KEY}, indicator string, source string, probabilities map<string,double>")
    assert {r["stock_code"]: r["impact"] for r in scoring.check_impacts(found, causes).collect()} == {"a": 0.0, "b": -7.5, "c": -15.0}


def test_rules_for_probabilities(spark):
    rows = [
        ("C", "涨价", "行业特性", False, False), ("B+", config.NO_EXPLANATION, "行业特性", False, False), ("C", None, "行业特性", False, False),
        ("C", "涨价", "行业特性", True, False), ("C", None, None, False, False), ("C", "涨价", None, False, False), ("C", "涨价", "涨价", False, False),
    ]
    df = spark.createDataFrame(rows, "source string, path1 string, path2 string, is_vague boolean, conflict boolean")
    got = reasoning.rule_probabilities(df)
    assert [r["probabilities"] for r in got.collect()] == [
        {"涨价": 0.7, "行业特性": 0.1, "其他": 0.2}, {"行业特性": 1.0}, {"行业特性": 0.8, "其他": 0.2},
        {"涨价": 0.4, "行业特性": 0.4, "其他": 0.2}, {"其他": 1.0}, {"涨价": 0.8, "其他": 0.2}, {"涨价": 0.8, "其他": 0.2},
    ]
    assert got.where(~reasoning.valid_probabilities(F.col("probabilities"))).count() == 0


def test_attribution_line_and_bad_probabilities(spark):
    p = F.create_map(*[F.lit(x) for x in ("经营滞销", 0.6, "战略备货", 0.3, "其他", 0.1)])
    assert one(spark, reasoning.attribution_line(F.lit("存货周转率"), p)) == "存货周转率 => 归因：经营滞销(60%)，战略备货(30%)，其他(10%)"
    assert one(spark, reasoning.valid_probabilities(p)) is True
    assert one(spark, reasoning.valid_probabilities(F.create_map(F.lit("a"), F.lit(0.5), F.lit("其他"), F.lit(0.5)))) is False
    assert one(spark, reasoning.valid_probabilities(F.create_map(F.lit("a"), F.lit(0.5)))) is False


@pytest.mark.parametrize(("raw", "k"), [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('```\n{"k": 3}```  ', 3), ("not json", None), (None, None)])
def test_fenced_responses(spark, raw, k):
    got = one(spark, reasoning.parsed_response(F.lit(raw).cast("string"), "k int"))
    assert (got["k"] if got is not None else None) == k
    assert raw is None or "`" not in one(spark, fenced(F.lit(raw)))


def test_provider_cache_and_errors(spark):
    calls = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("p", "bad")], "prompt_name string, variables string")
    cache = calls.where("variables = 'b'").select(reasoning.cache_key(F.col("prompt_name"), F.col("variables")).alias("cache_key"))
    misses = reasoning.cache_misses(calls, cache)
    assert misses.count() == 2

    def provider():
        def answer(name, variables):
            if variables == "bad":
                raise ValueError("no")
            return f"{name}:{variables}"

        return answer

    got = {r["response"]: r["error"] for r in reasoning.ask(misses, provider).collect()}
    assert got == {"p:a": None, None: "ValueError: no"}


def test_prompts_render_and_miss_nothing(spark):
    assert "毛利率" in one(spark, prompts.rendered("d2_probability", {v: F.lit("毛利率") for v in prompts.variables("d2_probability")}))
    with pytest.raises(KeyError):
        prompts.rendered("d2_probability", {})


def test_tag_violations_and_aliases(spark):
    df = spark.createDataFrame([("a", "客户类型", "To-C端"), ("b", "客户类型", "自创")], "stock_code string, dimension string, value string")
    assert [r["stock_code"] for r in reasoning.tag_violations(df, config.soft_tags(spark), config.tag_aliases(spark)).collect()] == ["b"]


def test_tables_over_pages_and_blocks(spark):
    rows = [(1, i, x) for i, x in enumerate(["第一节", "h|v", "a|1", "", "h|v", "a|1", "文字", "第二节", "g|v"])]
    df = spark.createDataFrame(rows, "doc int, pos int, line string")
    got = documents.tables(df.where("line <> ''"), F.col("line").contains("|"), F.col("line").rlike("v$")).orderBy("pos")
    assert [(r["pos"], r["table_id"]) for r in got.collect()] == [(1, 1), (2, 1), (4, 1), (5, 1), (8, 2)]
    assert sorted((r["table_id"], r["pos"]) for r in documents.distinct_rows(got).collect()) == [(1, 1), (1, 2), (2, 8)]
    assert [r["block"] for r in documents.blocks(df, F.col("line").rlike("节$")).orderBy("pos").collect()][-1] == "第二节"


def test_points_and_report(spark):
    import json

    impacts = spark.createDataFrame([("a", 2024, "毛利率", "C", 2.0), ("a", 2024, "净" * 60, "B+", -1.0), ("a", 2024, "x", "C", 0.0)], f"{KEY}, name string, source string, impact double")
    points = report.points(impacts)
    scores = spark.createDataFrame([("a", 2024, 99.0, "high", 1.0, 0.0)], f"{KEY}, final_score double, tier string, c_impact double, bplus_impact double")
    items = spark.createDataFrame([("a", 2024, "C", "毛利率", "extreme", 0.5), ("a", 2024, "B+", "存贷双高", "abnormal", 0.1)], f"{KEY}, source string, name string, severity string, value double")
    causes = spark.createDataFrame([("a", 2024, "毛利率", "C", {"经营恶化": 0.3, "行业特性": 0.7})], f"{KEY}, indicator string, source string, probabilities map<string,double>")
    said = spark.createDataFrame([("a", 2024, "毛利率", "s", 7)], f"{KEY}, indicator string, summary string, page_number int")
    anomalies = report.explained(items, causes, said)
    peers_ = spark.createDataFrame([("a", "q", 0.5, 2), ("a", "p", 0.9, 1)], "stock_code string, peer_code string, similarity double, rank int")
    blocked = spark.createDataFrame([("b", 2024, config.BLOCKED)], f"{KEY}, message string")
    got = {r["stock_code"]: json.loads(r["report"]) for r in report.assemble(scores, anomalies, points, peers_, blocked).collect()}
    assert got["a"]["overall"]["tier"] == "high" and len(got["a"]["points"]["bull"]) == len(got["a"]["points"]["bear"]) == 1
    assert got["a"]["points"]["bear"][0].endswith("（来源：B+）") and len(got["a"]["points"]["bear"][0]) == 50
    assert [p["peer_code"] for p in got["a"]["overall"]["peer_comparison"]] == ["p", "q"]
    by = {a["name"]: a for a in got["a"]["core_anomalies"]}
    assert by["毛利率"]["probabilities"] == {"行业特性": 0.7, "经营恶化": 0.3} and by["毛利率"]["page_number"] == 7 and "probabilities" not in by["存贷双高"]
    assert got["b"]["message"] == config.BLOCKED
    leaves = report.leaves(report.assemble(scores, anomalies, points, peers_, blocked))
    assert sorted(r["module"] for r in leaves.collect()) == ["anomaly", "anomaly", "bear", "blocked", "bull", "cause", "cause", "overall", "overall", "overall", "peer", "peer"]


def test_keywords_are_found_within_chinese(spark):
    rows = spark.createDataFrame([(1, "本期毛利率下降"), (2, "净利率与毛利率"), (3, "毛利"), (4, None), (5, "")], "key int, text string")
    got = {(r["key"], r["indicator"], r["hits"]) for r in reasoning.relevant_sections(rows, [("毛利率", "毛利率"), ("净利率", "净利率"), ("下降", "毛利率")]).collect()}
    assert got == {(1, "毛利率", 2), (2, "毛利率", 1), (2, "净利率", 1)}
    assert reasoning.relevant_sections(rows, []).count() == 0


def test_evidence_is_the_first_sentence_that_names_it(spark):
    rows = spark.createDataFrame([("a", 2024, "t", "无关。毛利率因多种因素下降！毛利率再降", 9), ("a", 2024, "t", "毛利率上升。", 12), ("b", 2024, "t", "毛利率", 1), ("a", 2023, "t", None, 1)], "stock_code string, year int, title string, content string, page_number int")
    asked = spark.createDataFrame([("a", 2024, "毛利率"), ("a", 2024, "净利率")], f"{KEY}, indicator string")
    got = reasoning.evidence(asked, rows, config.keywords()).collect()
    assert [(r["source_text"], r["page_number"], r["is_vague"]) for r in got] == [("毛利率因多种因素下降！", 9, True)]


def test_levels_of_cash_ratios(spark):
    w = wide(spark, [(100, -1, 20, 100, 0, 1, 0), (100, 50, 50, 100, 0, 1, 0), (100, 100, 100, 100, 0, 1, 0), (100, 201, 151, 100, 0, 1, 0)])
    got = {(r["year"], r["ratio"]): r["level"] for r in logic_checks.cash_levels(w).collect()}
    assert [got[y, "cash_to_profit"] for y in range(2020, 2024)] == [got[y, "cash_to_revenue"] for y in range(2020, 2024)] == ["severe", "low", "normal", "high"]


def test_parts_of_a_report(spark):
    lines = ["前言", "第二节 公司简介", "x", "合并资产负债表", "1", "资产负债表附注", "y", "第四节 经营情况讨论与分析", "其他", "z"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, pos int, line string")
    got = [r["part"] for r in documents.parts(rows, F.char_length("line") > 1).orderBy("pos").collect()]
    assert got == [None, *["company_overview"] * 2, *["financial_data"] * 2, *["footnotes"] * 2, *["management_discussion"] * 3]


def test_facts_of_answers(spark):
    read = lambda raw: one(spark, reasoning.extract_facts(F.lit(raw)))
    assert read('```json\n["一", "强烈看好"]\n```') == ["一"] and read("1. 一\n- 二\n\n未找到客观数据") == ["一", "二"] and read("未找到客观数据。") == []
    assert one(spark, reasoning.read_probabilities(F.lit('{"probabilities": {"a": 0.5, "其他": 0.5}}'))) is None
    assert len(one(spark, reasoning.read_hypotheses(F.lit("[" + ",".join(['{"hypothesis": "h"}'] * 6) + "]")))) == 4


def test_file_names(spark):
    code, year = reports.named(F.lit("data/raw/000858_2024.pdf"))
    assert (one(spark, code), one(spark, year)) == ("000858", 2024)
