"""Files in and out: extracted documents, benchmarks, reports, stages and the stream."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finsift.plans import stages
from finsift.sources import reports
from finsift.sources.config import BLOCKED, GROUP, PARENT
from finsift.streaming.ingest import ingest, latest


def document(n=1):
    return {
        "metadata": {"file": "x"},
        "financial_data": {"balance_sheet": [{"资产总计": f"{n},000"}], "income_statement": [{"营业收入": "1"}], "cashflow_statement": [{"a": "1"}]},
        "management_discussion": {"sections": [{"title": "t", "content": "c", "page_number": 3}]},
        "footnotes": {"items": [{"name": "n", "content": "c", "page_number": 4}]},
    }


def test_documents_cells_and_parts(spark, tmp_path):
    (tmp_path / "000858_2024.json").write_text(json.dumps(document(), indent=1))
    (tmp_path / "600519_2023.json").write_text(json.dumps({"metadata": {"file": "y"}}))
    docs = reports.read_documents(spark, str(tmp_path))
    assert {(r["stock_code"], r["year"]) for r in docs.collect()} == {("000858", 2024), ("600519", 2023)}
    assert reports.cells(docs).where("statement = 'balance_sheet'").first()["text"] == "1,000"
    assert {r["doc"]: r["complete"] for r in reports.parts_present(docs).collect()} == {"000858_2024": True, "600519_2023": False}
    files = spark.createDataFrame([("000858", 2024), ("000001", 2020)], "stock_code string, year int")
    assert [r["stock_code"] for r in reports.unprocessed(files, docs).collect()] == ["000001"]


def test_benchmarks_round_trip_keeps_zeros_and_prunes(spark, tmp_path):
    (tmp_path / "b.csv").write_text("stock_code,industry,year,indicator,value\n600519,白酒,2024,存货周转率,0.18\n000858,白酒,2024,存货周转率,0.32\n")
    reports.write_benchmarks(reports.read_benchmarks(spark, str(tmp_path / "b.csv")), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["stock_code"] for r in back.collect()} == {"600519", "000858"}
    assert "PartitionFilters: [isnotnull(year" in back.where("year = 2024")._jdf.queryExecution().toString()


def test_reports_replace_only_their_own(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "stock_code string, year int, report string")
    reports.write_reports(rows(("a", 2024, "1"), ("b", 2024, "2")), str(tmp_path / "r"))
    reports.write_reports(rows(("b", 2024, "3")), str(tmp_path / "r"))
    reports.write_reports(rows(*((f"c{i}", 2023, "x") for i in range(300))), str(tmp_path / "r"))
    got = {(r["stock_code"], r["report"]) for r in reports.read_reports(spark, str(tmp_path / "r")).where("year = 2024").collect()}
    assert got == {("a", "1"), ("b", "3")}
    assert reports.read_reports(spark, str(tmp_path / "r")).where("year = 2023").count() == 300
    assert len(list((tmp_path / "r" / "year=2023").iterdir())) <= reports.BUCKETS  # not a folder for each company


def test_benchmarks_of_one_industry_leave_the_others(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "stock_code string, industry string, year int, indicator string, value double")
    for value, industry in ((1.0, "A"), (2.0, "B"), (3.0, "B")):
        reports.write_benchmarks(rows(("1", industry, 2024, "x", value)), str(tmp_path / "b"))
    assert {(r["industry"], r["value"]) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {("A", 1.0), ("B", 3.0)}


def test_search_results_become_the_text_of_a_prompt(spark, tmp_path):
    lines = [{"query": "q", "rank": r, "title": f"t{r}", "url": u, "published": "2024-01-02", "snippet": "s"} for r, u in ((2, "b"), (1, "a"), (3, "a"), (4, None))]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, lines)))
    got = reports.search_text(reports.read_search_results(spark, str(tmp_path))).first()
    assert got["search_query"] == "q" and got["search_results"] == "[2024-01-02] t1 s (a)\n[2024-01-02] t2 s (b)"


def test_settings_replace_what_a_folder_has(spark, tmp_path, monkeypatch):
    from finsift.operators import deviation
    from finsift.sources import config, prompts, settings

    for name in ("INDICATORS", "ABNORMAL", "EXTREME", "BOTH_HIGH", "CASH_NORMAL", "CASH_TO_PROFIT", "CASH_TO_REVENUE", "GAP_SEVERE", "GAP_WARNING", "SOFT_TAGS", "FIELDS"):
        monkeypatch.setattr(config, name, getattr(config, name))
    monkeypatch.setattr(prompts, "TEMPLATES", dict(prompts.TEMPLATES))
    (tmp_path / "thresholds.json").write_text(json.dumps({"c_layer": {"mad_threshold": 3, "extreme_threshold": 4}, "bplus": {"净现比": {"normal_range": [0.5, 3], "severe_threshold": 0}}}))
    (tmp_path / "weights.json").write_text(json.dumps({"weights": {"毛利率": {"category": "c", "base_weight": 7, "direction": "positive", "amplification_cap": 2}}}))
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "d1_hypothesis.json").write_text(json.dumps({"name": "d1_hypothesis", "messages": [{"role": "user", "content": "mine {{indicator}}"}]}))
    settings.use(spark, str(tmp_path))
    assert [r["base_weight"] for r in config.weights(spark).collect()] == [7.0] and config.CASH_TO_PROFIT == (0.5, 3.0, 0.0) and config.GAP_SEVERE == 0.3
    got = spark.sql("select explode(array(2.5, 3.5, 4.5)) m").select(deviation.level(F.col("m")).alias("l")).collect()
    assert [r["l"] for r in got] == ["normal", "abnormal", "extreme"] and prompts.variables("d1_hypothesis") == ["indicator"]


def test_yaml_settings_are_read(spark, tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    from finsift.sources import config, settings

    for name in ("FIELDS", "SOFT_TAGS"):
        monkeypatch.setattr(config, name, getattr(config, name))
    (tmp_path / "financial_fields.yaml").write_text("fields:\n  Revenue_Total:\n    chinese_variants: [营业收入, 收入]\n    type: profit_loss\n")
    (tmp_path / "industry_tags.yaml").write_text("soft_tags:\n  - name: 资产结构\n    options: [重, 轻]\n")
    settings.use(spark, str(tmp_path))
    assert [r["raw_name"] for r in config.fields(spark).collect()] == ["营业收入", "收入"] and config.SOFT_TAGS == (("资产结构", ("重", "轻")),)


def test_pdfs_go_through_any_parser(spark, tmp_path):
    (tmp_path / "000858_2024.pdf").write_bytes(b"%PDF")
    text = json.dumps(document(7))
    got = reports.read_pdfs(spark, str(tmp_path), lambda b: text).first()
    assert got["stock_code"] == "000858" and got["document"]["financial_data"]["balance_sheet"][0]["资产总计"] == "7,000"


def test_stream_takes_new_documents_once(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "000001_2024.json").write_text(json.dumps(document(1)))
    ingest(spark, str(folder), out, check).awaitTermination(120)
    (folder / "000002_2024.json").write_text(json.dumps(document(2)))
    ingest(spark, str(folder), out, check).awaitTermination(120)
    (folder / "000002_2024.json").unlink()
    (folder / "new_000002_2024.json").write_text(json.dumps(document(3)))
    ingest(spark, str(folder), out, check).awaitTermination(120)
    got = latest(spark.read.schema("statement string, row int, name string, text string, stock_code string, year int, batch long").parquet(out))
    assert {(r["stock_code"], r["text"]) for r in got.where("statement = 'balance_sheet'").collect()} == {("000001", "1,000"), ("000002", "3,000")}


@pytest.fixture(scope="module")
def inputs(spark):
    names = ["Revenue_Total", "Cost_Revenue", "Gross_Profit", "Net_Profit", "Total_Assets", "Total_Liabilities", "Equity_Total", "Monetary_Funds", "Operating_Cash_Flow", "Operating_Cash_Inflow", "Interest_Debt", "Retained_Begin", "Retained_End", "Dividends"]
    rows = []
    for n in range(8):
        values = [100, 50 + n, 50 - n, 20 - n, 100, 60, 40 + 5 * (n == 7), 40, 5, 30, 40, 10, 20, 0]
        rows += [(f"{n:06d}", "x", y, GROUP, k, Decimal(v)) for y in (2023, 2024) for k, v in zip(names, values, strict=True)]
        rows += [(f"{n:06d}", "x", 2024, PARENT, "Monetary_Funds", Decimal(1))]
    facts = spark.createDataFrame(rows, "stock_code string, industry string, year int, report_type string, standard_name string, value decimal(38,4)")
    tags = spark.createDataFrame([(f"{n:06d}", "x", "t") for n in range(8)], "stock_code string, industry string, tag string")
    why = spark.createDataFrame([("000000", 2024, "存贷双高", "B+", None, "行业特性", False, False)], "stock_code string, year int, indicator string, source string, path1 string, path2 string, is_vague boolean, conflict boolean")
    return {"facts": facts, "tags": tags, "explanations": why}


def test_stages_run_resume_and_skip(spark, inputs, tmp_path):
    made = stages.run(spark, inputs, str(tmp_path))
    got = {(r["stock_code"], r["year"]): json.loads(r["report"]) for r in made["reports"].collect()}
    assert got["000007", 2024]["message"] == BLOCKED and len(got) == 16
    assert all(0 <= g["overall"]["final_score"] <= 100 for g in got.values() if "overall" in g)
    assert {a["name"] for a in got["000000", 2024]["core_anomalies"]} >= {"存贷双高", "母子资金分离度"}
    again = stages.run(spark, inputs, str(tmp_path), start="scores")
    assert {(r["stock_code"], r["year"]): json.loads(r["report"]) for r in again["reports"].collect()} == got
    assert "reports" not in stages.run(spark, inputs, str(tmp_path / "b"), skip=("reports",))


def test_row_order_does_not_matter(spark, inputs, tmp_path):
    a = stages.run(spark, inputs, str(tmp_path / "a"))["scores"]
    mixed = inputs | {"facts": inputs["facts"].orderBy(F.rand(3))}
    b = stages.run(spark, mixed, str(tmp_path / "b"))["scores"]
    assert sorted(a.collect()) == sorted(b.collect())


def report_of(n, year):
    """An extracted document with whole statements; the seventh company's don't balance."""
    sheet = {"资产总计": "100", "负债合计": "60", "所有者权益合计": str(40 + 5 * (n == 7)), "货币资金": "４０", "有息负债": "40", "期初未分配利润": "10", "期末未分配利润": "(20)", "备注": "无"}
    flow = {"经营活动产生的现金流量净额": "5", "销售商品、提供劳务收到的现金": "30"}
    income = {"营业收入": "100", "主营业务收入": "77", "营业成本": str(50 + n), "毛利润": str(50 - n * n), "净利润": "2,0" + str(n), "unit": "元"}
    return {
        "metadata": {"unit": "万元", "company_name": f"c{n}"},
        "financial_data": {"balance_sheet": [sheet, {"货币资金": "1", "report_type": PARENT}], "income_statement": [income], "cashflow_statement": [flow]},
        "management_discussion": {"sections": [{"title": "经营情况讨论", "content": "本期平稳。毛利率下降系原料涨价所致！其他略。", "page_number": 31}]},
        "footnotes": {"items": [{"name": "货币资金", "content": "货币资金受多种因素影响。", "page_number": 88}]},
        "company_overview": {"business_description": "b", "industry_classification": "白酒"},
    }


def test_documents_become_reports(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(8):
        (folder / f"{n:06d}_2024.json").write_text(json.dumps(report_of(n, 2024), ensure_ascii=False))
    tags = spark.createDataFrame([(f"{n:06d}", "白酒", "t") for n in range(8)], "stock_code string, industry string, tag string")
    made = stages.run(spark, {"documents": reports.read_documents(spark, str(folder)), "tags": tags}, str(tmp_path / "work"))
    facts = {(r["report_type"], r["standard_name"]): r["value"] for r in made["facts"].where("stock_code = '000003'").collect()}
    assert facts[GROUP, "Monetary_Funds"] == Decimal("400000") and facts[PARENT, "Monetary_Funds"] == Decimal("10000")
    assert facts[GROUP, "Revenue_Total"] == Decimal("100") and facts[GROUP, "Net_Profit"] == Decimal("203") and facts[GROUP, "Retained_End"] == Decimal("-200000")
    assert {(r["raw_name"], r["reason"]) for r in made["unreadable"].collect()} == {("备注", "name")}
    got = {r["stock_code"]: json.loads(r["report"]) for r in made["reports"].collect()}
    assert got["000007"] == {"message": BLOCKED} and len(got) == 8
    one = got["000006"]
    assert [p["peer_code"] for p in one["overall"]["peer_comparison"]] == [f"{n:06d}" for n in range(5)] and one["overall"]["tier"] in ("high", "medium", "low")
    by = {a["name"]: a for a in one["core_anomalies"]}
    assert by["毛利率"]["page_number"] == 31 and by["毛利率"]["summary"] == "毛利率下降系原料涨价所致！" and by["毛利率"]["probabilities"] == {"毛利率下降系原料涨价所致！": 0.8, "其他": 0.2}
    assert by["存贷双高"]["page_number"] == 88
    assert any("毛利率" in p and "来源：C" in p for p in one["points"]["bear"]) and all(len(p) <= 50 for p in one["points"]["bear"])
    assert "reports" not in stages.run(spark, {"documents": reports.read_documents(spark, str(folder)), "tags": tags}, str(tmp_path / "b"), skip=("gate",))


def test_dual_path_asks_once_and_reads_answers(spark, tmp_path):
    from finsift.operators import reasoning

    log = tmp_path / "log"

    def provider():
        def answer(name, variables):
            with log.open("a") as f:
                f.write(name + "\n")
            if name == "d1_lookup_notes":
                return '```json\n{"summary": "原料涨价", "source_text": "t", "page_number": 3, "is_vague": false}\n```' if "毛利率" in variables else "无直接解释"
            if name == "d1_hypothesis":
                return '[{"hypothesis": "行业特性", "reasoning": "r", "source": "标签"}]'
            return '{"probabilities": {"原料涨价": 0.9, "其他": 0.1}}' if "原料涨价" in variables else "no JSON"

        return answer

    asked = spark.createDataFrame([("1", 2024, "毛利率", "C", 0.5, 3.0), ("1", 2024, "存贷双高", "B+", 0.2, None)], "stock_code string, year int, indicator string, source string, actual double, multiple double")
    found = spark.createDataFrame([("1", 2024, "毛利率", "s", "原文", 3, False)], "stock_code string, year int, indicator string, summary string, source_text string, page_number int, is_vague boolean")
    context = spark.createDataFrame([("1", "事实", "白酒")], "stock_code string, macro_facts string, industry_tags string")
    cache = str(tmp_path / "cache")
    for only in (False, True):  # the second time nothing is asked
        got = {r["indicator"]: r for r in reasoning.dual_path(asked, found, context, provider, cache, only_cache=only, wait=0.0).collect()}
        assert got["毛利率"]["lookup"]["page_number"] == 3 and got["毛利率"]["probabilities"] == {"原料涨价": 0.9, "其他": 0.1}
        assert got["存贷双高"]["lookup"] is None and got["存贷双高"]["probabilities"] == {"行业特性": 1.0}
    assert sorted(log.read_text().split()) == ["d1_hypothesis"] * 2 + ["d1_lookup_notes"] * 2 + ["d2_probability"] * 2


def test_asking_waits_times_out_and_checks(spark):
    from finsift.operators import reasoning

    def provider():
        import time

        def answer(name, variables):
            if variables == "slow":
                time.sleep(3)
            return "bad" if variables == "bad" else "一二three"

        return answer

    calls = spark.createDataFrame([(v, "p", v) for v in ("ok", "slow", "bad")], "cache_key string, prompt_name string, variables string")
    got = {r["cache_key"]: r for r in reasoning.ask(calls, provider, tries=2, wait=0.1, timeout=0.5, check=lambda name, a: a != "bad").collect()}
    assert got["ok"]["response"] == "一二three" and got["ok"]["tries"] == 1 and got["ok"]["answer_tokens"] == 4
    assert got["slow"]["error"].startswith("TimeoutError") and got["slow"]["tries"] == 2 and got["slow"]["seconds"] >= 1
    assert got["bad"]["response"] is None and "form" in got["bad"]["error"]
