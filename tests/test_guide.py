"""Grids, names outside the vocabulary, facts of industries, the gateway, and runs that
resume by content."""

import json
import threading
import time
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finsift.operators import gateway, guide, macro, mapping, naming, reasoning
from finsift.plans import stages
from finsift.sources import config, prompts, reports, settings
from finsift.sources.config import GROUP, PARENT


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


GRID = [
    {"table_id": 0, "title": "合并资产负债表", "unit": None, "page_number": 5, "rows": [["", "单位：万元"], ["项目", "附注", "期末余额", "期初余额"], ["资产总计", "", "100", "90"], ["负债合计", "七", "60", "50"], ["股东权益合计", "", "40", "40"], ["一、未分配利润（元）", "", "(20)", "10"], ["净 资产合计计", "", "1", "2"]]},
    {"table_id": 1, "title": "母公司资产负债表", "unit": "千元", "page_number": 6, "rows": [["项目", "2023年12月31日", "2024年12月31日"], ["货币资金", "5", "7"], ["备注", "x", "—"]]},
    {"table_id": 2, "title": "利润表", "unit": None, "page_number": 7, "rows": [["项目", "本期金额", "上期金额", "同比增减"], ["营业总收人", "1,000.5", "900", "11%"], ["非流动负债", "3", "4", "1"]]},
    {"table_id": 3, "title": None, "unit": None, "page_number": 8, "rows": [["甲", "乙"], ["资产总计", "5"], []]},
    {"table_id": 4, "title": None, "unit": None, "page_number": 8, "rows": []},
]


def gridded(spark, tmp_path):
    (tmp_path / "000001_2024.json").write_text(json.dumps({"metadata": {"company_name": "c"}, "company_overview": {"industry_classification": "i"}, "grids": GRID}, ensure_ascii=False))
    (tmp_path / "000002_2024.json").write_text(json.dumps({"metadata": {"file": "x"}}))
    return reports.read_documents(spark, str(tmp_path))


def test_headers_guide_coordinates(spark, tmp_path):
    cells = guide.grid_cells(gridded(spark, tmp_path))
    said = guide.headers(cells)
    assert not said.where("text in ('100', '90', '(20)', '1,000.5', '7')").count()  # the guide sees no amount
    learned = naming.suggestions(said.select(naming.cleaned(F.col("text")).alias("raw_name")))
    found = guide.period_facts(cells, guide.header_guide(said, learned))
    got = {(r["report_type"], r["standard_name"], r["role"]): r["value"] for r in found.where("standard_name is not null").collect()}
    wan = lambda n: Decimal(n) * 10000
    assert got[GROUP, "Total_Assets", "end_balance"] == wan(100) and got[GROUP, "Total_Assets", "begin_balance"] == wan(90)
    assert got[GROUP, "Retained_End", "end_balance"] == -20 and got[GROUP, "Retained_End", "begin_balance"] == 10  # the row's own unit
    assert got[PARENT, "Monetary_Funds", "end_balance"] == 7000 and got[PARENT, "Monetary_Funds", "begin_balance"] == 5000  # dated columns in any order
    assert got[GROUP, "Revenue_Total", "year"] == Decimal("1000.5") and got[GROUP, "Revenue_Total", "previous_year"] == 900
    assert {(r["raw_name"], r["text"]) for r in found.where("reason = 'text'").collect()} >= {("备注", "x")}
    facts = {(r["report_type"], r["standard_name"]): r["value"] for r in guide.statement_facts(found).collect()}
    assert facts[GROUP, "Retained_Begin"] == 10 and facts[GROUP, "Retained_End"] == -20 and facts[GROUP, "Total_Assets"] == wan(100)
    assert guide.header_guide(said.limit(0)).count() == 0


def test_a_model_can_guide_but_only_by_what_it_was_shown(spark, tmp_path):
    cells = guide.grid_cells(gridded(spark, tmp_path))
    said = guide.headers(cells)
    asked = {r["table_id"]: r["variables"] for r in guide.guide_calls(said).collect()}
    assert "1:2:期末余额" in asked[0] and "100" not in asked[0]
    answer = {
        "table_name": "资产负债表", "report_type": "合并报表", "unit": "万元", "columns": {"期末余额": "end_balance", "没有的": "begin_balance"},
        "field_mapping": [
            {"raw_name": "资产总计", "standard_name": "Total_Assets", "location": {"row_start": 2}},
            {"raw_name": "一、未分配利润（元）", "standard_name": "Retained_End", "unit": "元", "location": {"row_start": 5, "col_index": 2}},
            {"raw_name": "资产总计", "standard_name": "Equity_Total", "location": {"row_start": 3}},
            {"raw_name": "负债合计", "standard_name": "Made_Up", "location": {"row_start": 3}},
        ],
    }
    answers = spark.createDataFrame([("000001_2024", 0, "```json\n" + json.dumps(answer, ensure_ascii=False) + "\n```"), ("000001_2024", 1, "no JSON")], "doc string, table_id int, response string")
    found = guide.period_facts(cells, guide.answered_guide(said, answers))
    assert {(r["standard_name"], r["role"], r["value"]) for r in found.collect()} == {("Total_Assets", "end_balance", Decimal(1000000)), ("Retained_End", "end_balance", Decimal(-20))}


#: Names with edits, and what they stand for; and names that only look alike.
PLANTED = {
    "营业总收人": "Revenue_Total", "营业 总收入": "Revenue_Total", "一、营业收入": "Revenue_Total", "其中：主营业务收入": "Revenue_Total", "营业成本（万元）": "Cost_Revenue", "主营业务成夲": "Cost_Revenue",
    "归属于母公司股东净利润": "Net_Profit", "归属母公司股东的净利润": "Net_Profit", "资产总汁": "Total_Assets", "负债合计数": "Total_Liabilities", "所有者权益总计": "Equity_Total", "货币资金期末余頟": "Monetary_Funds",
    "经营活动产生的现金流量净頟": "Operating_Cash_Flow", "经营活动的现金流量净额": "Operating_Cash_Flow", "销售商品、提供劳务收到现金": "Operating_Cash_Inflow", "应收帐款": "Receivables", "流动负债合汁": "Current_Liabilities", "期未未分配利润": "Retained_End",
    "非流动资产合计": None, "流动资产小计": None, "其他应收账款": None, "投资活动现金流量净额": None, "商誉": None, "营业外收入": None, "净利": "Net_Profit", "": None, "少数股东权益合计": None,
}


def test_names_with_edits_are_found_and_others_left_alone(spark):
    names = spark.createDataFrame([(n,) for n in PLANTED for _ in range(2)] + [(None,)], "raw_name string")
    got = {r["raw_name"]: r for r in naming.suggestions(names).collect()}
    hits = [n for n, s in PLANTED.items() if s]
    right = sum(n in got and got[n]["standard_name"] == PLANTED[n] for n in hits)
    wrong = sum(r["standard_name"] != PLANTED[n] for n, r in got.items())
    assert right >= 0.95 * len(hits) and wrong <= 0.05 * len(got), (set(hits) - got.keys(), [n for n, r in got.items() if r["standard_name"] != PLANTED[n]])
    assert naming.suggestions(names.limit(0)).count() == 0


def test_no_near_name_is_missed(spark):
    import random

    rng, known = random.Random(8), [v for _, _, names in config.FIELDS for v in names]
    letters = "".join(known) + "的额数"
    raws = []
    for _ in range(150):
        w = list(rng.choice(known))
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice([[], [rng.choice(letters)]])
        raws.append("".join(w))
    got = {r["raw_name"]: round(r["confidence"], 6) for r in naming.suggestions(spark.createDataFrame([(r,) for r in raws], "raw_name string")).collect()}
    fields = {v: s for s, _, names in config.FIELDS for v in names}
    alike = lambda n, k: all(q in k for q in config.QUALIFIERS if q in n) and all(q in n for q in config.MARKERS if q in k)
    for raw in set(raws):
        near = [(1 - levenshtein(raw, k) / max(len(raw), len(k)), fields[k]) for k in known if alike(raw, k)] if raw else []
        near = [n for n in near if n[0] >= 2 / 3 - 1e-9]
        best = max((c for c, _ in near), default=0)
        one = len({s for c, s in near if c == best}) == 1
        assert got.get(raw) == (pytest.approx(best, abs=1e-6) if one else None), raw


def test_learned_aliases_come_first_next_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "aliases")
    names = spark.createDataFrame([("营业总收人",), ("商誉",)], "raw_name string")
    assert [r["standard_name"] for r in naming.learn(names, path).collect()] == ["Revenue_Total"]
    looked = []
    monkeypatch.setattr(naming, "suggestions", lambda new, least, f=naming.suggestions: looked.append(sorted(r["raw_name"] for r in new.collect())) or f(new, least))
    known = naming.learn(names, path)
    assert looked == [["商誉"]] and known.count() == 1
    got = {r["raw_name"]: r["standard_name"] for r in mapping.map_names(names, known).collect()}
    assert got == {"营业总收人": "Revenue_Total", "商誉": None}


def test_facts_as_of_the_year_newest_first_and_folded(spark):
    rows = [
        ("酒", date(2023, 5, 1), "2023年5月 粮价上涨5%（统计局）"), ("酒", date(2023, 6, 1), "粮价上涨5%"), ("酒", date(2022, 1, 2), "产量持平"), ("酒", date(2024, 1, 1), "later"),
        ("酒", date(2023, 7, 1), "推荐买入"), ("酒", None, "undated"), ("酒", date(2023, 1, 1), " "), ("车", date(2021, 3, 3), "旧"), (None, date(2023, 1, 1), "x"), ("酒", date(2023, 2, 1), config.NO_FACTS),
    ]
    facts = spark.createDataFrame(rows, "industry string, published date, text string")
    asked = spark.createDataFrame([("酒", 2023), ("酒", 2023), ("车", 2023), ("酒", 2020)], "industry string, year int")
    got = {(r["industry"], r["year"]): (r["macro_facts"], r["n_facts"]) for r in macro.as_of(facts, asked).collect()}
    assert got == {("酒", 2023): ("2023-06-01 粮价上涨5%\n2022-01-02 产量持平", 2), ("车", 2023): (config.NO_FACTS, 0), ("酒", 2020): (config.NO_FACTS, 0)}
    assert {r["n_facts"] for r in macro.as_of(facts, asked, most=1).collect()} == {0, 1}


def test_calls_run_side_by_side_within_the_budget_and_fall_back(spark, tmp_path):
    log = tmp_path / "log"

    def provider():
        busy, lock = [0, 0], threading.Lock()

        def first(name, text):
            with lock:
                busy[0] += 1
                busy[1] = max(busy)
                with log.open("a") as f:
                    f.write(f"{time.time()} {busy[1]}\n")
            time.sleep(0.05)
            with lock:
                busy[0] -= 1
            if text.startswith("bad"):
                raise RuntimeError("down")
            return "ok", 7, 3

        return {"one": first, "two": lambda name, text: "second"}

    calls = spark.createDataFrame([(f"k{i}", "p", ("bad" if i % 10 == 0 else "good") + str(i)) for i in range(60)], "cache_key string, prompt_name string, variables string")
    began = time.time()
    rows = {r["cache_key"]: r for r in gateway.ask(calls, provider, tries=2, wait=0.0, concurrency=6, per_second=60, partitions=2).collect()}
    took = time.time() - began
    seen = [(float(t), int(n)) for t, n in (x.split() for x in log.read_text().splitlines())]
    assert len(rows) == 60 and len(seen) == 66  # a failing one twice
    assert 2 <= max(n for _, n in seen) <= 6 and took >= 30 / 30 - 0.2
    times = sorted(t for t, _ in seen)
    assert all(sum(a <= t < a + 0.5 for t in times) <= 32 + 4 for a in times)  # the budget's half second, each partition's first call besides
    assert rows["k0"]["vendor"] == "two" and rows["k0"]["response"] == "second" and rows["k0"]["tries"] == 3
    assert rows["k1"]["vendor"] == "one" and (rows["k1"]["prompt_tokens"], rows["k1"]["answer_tokens"]) == (7, 3)


def test_the_log_counts_what_was_asked_and_strict_keeps_only_good_forms(spark, tmp_path):
    calls = spark.createDataFrame([("d2_probability", str(i)) for i in range(12)] * 2, "prompt_name string, variables string")

    def provider():
        def answer(name, text):
            if text == "3":
                raise RuntimeError("no")
            return ('{"probabilities": {"其他": 1.0}}', 5, 2) if int(text) % 2 == 0 else ('{"probabilities": {"其他": "much"}}', 5, 2)

        return answer

    cache = str(tmp_path / "cache")
    got = {r["variables"]: r["response"] for r in reasoning.answered(calls, provider, cache, strict=True, tries=2, wait=0.0).collect()}
    assert all((got[str(i)] is not None) == (i % 2 == 0) for i in range(12))
    used = spark.read.parquet(f"{cache}_log").first()
    stored = spark.read.parquet(cache)
    assert (used["calls"], used["errors"], used["tries"], used["answer_tokens"]) == (12, 1, 13, 22) and stored.count() == 6
    assert used["prompt_tokens"] == 11 * 5 + gateway.estimated_tokens("3")
    reasoning.answered(calls, provider, cache, strict=True, tries=1).count()  # only the others are asked again
    assert sorted(r["calls"] for r in spark.read.parquet(f"{cache}_log").collect()) == [6, 12]


def documents(spark, folder, n=8, grids=False):
    from tests.test_sources import report_of

    folder.mkdir(exist_ok=True)
    for i in range(n):
        told = report_of(i, 2024)
        if grids and i == 1:
            told["grids"] = GRID
        (folder / f"{i:06d}_2024.json").write_text(json.dumps(told, ensure_ascii=False))
    tags = spark.createDataFrame([(f"{i:06d}", "白酒", "t") for i in range(n)], "stock_code string, industry string, tag string")
    return {"documents": reports.read_documents(spark, str(folder)), "tags": tags}


def times(work):
    return {p.parent.parent.name: sorted(x.stat().st_mtime_ns for x in p.parent.parent.glob("*/manifest.json")) for p in work.glob("*/*/manifest.json")}


def test_changed_input_reruns_what_depends_on_it_and_nothing_else(spark, tmp_path, monkeypatch):
    inputs, work = documents(spark, tmp_path / "in"), tmp_path / "work"
    first = stages.run(spark, inputs, str(work))
    before = times(work)
    assert set(before) == set(stages.STAGES)
    # the same again: nothing runs
    for name in stages.STAGES:
        monkeypatch.setitem(stages.STAGES, name, lambda f, how, name=name: pytest.fail(name))
    again = stages.run(spark, documents(spark, tmp_path / "in"), str(work))
    assert sorted(again["reports"].collect()) == sorted(first["reports"].collect()) and times(work) == before
    monkeypatch.undo()
    # facts of industries reach the context and what reasons from it; statements don't change
    facts = spark.createDataFrame([("白酒", date(2024, 1, 1), "粮价上涨")], "industry string, published date, text string")
    ran = []
    for name, f in list(stages.STAGES.items()):
        monkeypatch.setitem(stages.STAGES, name, lambda x, how, name=name, f=f: ran.append(name) or f(x, how))
    stages.run(spark, inputs | {"macro_facts": facts}, str(work))
    assert set(ran) == {"context", "reasoning", "scores", "reports"}
    # a stage without its manifest was cut short: it runs again, and what it makes counts as it did
    ran.clear()
    (half,) = (work / "gate").glob("*/manifest.json")
    half.unlink()
    made = stages.run(spark, inputs, str(work))
    assert ran == ["gate"] and sorted(made["reports"].collect()) == sorted(first["reports"].collect())
    # other settings, another content
    ran.clear()
    monkeypatch.setattr(config, "ABNORMAL", 2.5)
    stages.run(spark, inputs, str(work))
    assert set(ran) == set(stages.STAGES)


def test_own_indicators_and_fields_reach_scores_and_grids_reach_facts(spark, tmp_path, monkeypatch):
    for name in ("INDICATORS", "FIELDS", "RATIOS", "GROWTHS"):
        monkeypatch.setattr(config, name, getattr(config, name))
    (tmp_path / "set").mkdir()
    fields = {s: {"type": t, "chinese_variants": list(v)} for s, t, v in config.FIELDS} | {"Remarks": {"type": "balance_sheet", "chinese_variants": ["备注数"]}}
    weights = {n: {"category": c, "base_weight": w, "direction": d, "amplification_cap": cap} for n, c, w, d, cap in config.INDICATORS}
    weights["现金占比"] = {"category": "c", "base_weight": 2, "direction": "positive", "amplification_cap": 2}
    (tmp_path / "set" / "financial_fields.json").write_text(json.dumps({"fields": fields}, ensure_ascii=False))
    (tmp_path / "set" / "weights.json").write_text(json.dumps({"weights": weights}))
    with pytest.raises(ValueError, match="现金占比"):
        settings.use(spark, str(tmp_path / "set"))
    weights["现金占比"]["ratio"] = ["Monetary_Funds", "Total_Assets"]
    (tmp_path / "set" / "weights.json").write_text(json.dumps({"weights": weights}))
    settings.use(spark, str(tmp_path / "set"))
    inputs = documents(spark, tmp_path / "in", grids=True)
    made = stages.run(spark, inputs, str(tmp_path / "work"))
    assert "Remarks" in made["group"].columns
    found = {(r["stock_code"], r["indicator"]): r["value"] for r in made["indicators"].collect()}
    assert found["000003", "现金占比"] == 0.4
    facts = {r["standard_name"]: r["value"] for r in made["facts"].where(f"stock_code = '000001' and report_type = '{GROUP}'").collect()}
    assert facts["Retained_Begin"] == 10 and facts["Retained_End"] == -20 and facts["Revenue_Total"] == Decimal(10_005_000)  # the grid before the list
    assert {r["known"] for r in made["learned"].where("raw_name = '营业总收人'").collect()} == {"营业总收入"}


def test_documents_to_reports_with_a_model(spark, tmp_path):
    log = tmp_path / "log"

    def provider():
        def answer(name, text):
            with log.open("a") as f:
                f.write(f"{name}\n")
            if name == "a0_macro_search":
                return '["2024年 粮价上涨", "推荐买入"]'
            if name == "b0_semantic_guide":
                return "no JSON"
            if name == "d1_lookup_notes":
                return '{"summary": "原料涨价", "source_text": "t", "page_number": 3, "is_vague": false}' if "毛利率" in text else config.NO_EXPLANATION
            if name == "d1_hypothesis":
                return json.dumps([{"hypothesis": "行业特性" if "粮价上涨" in text and "白酒" in text else "无据", "reasoning": "r", "source": "s"}], ensure_ascii=False)
            if name == "e2_report":
                bear = ["毛利率低于同行（来源：C）"] if " c6 " in f" {text} " else ["y" * 51]
                return json.dumps({"bull": [], "bear": bear}, ensure_ascii=False)
            return '{"probabilities": {"原料涨价": 0.9, "其他": 0.1}}' if "原料涨价" in text else "no JSON"

        return answer

    inputs = documents(spark, tmp_path / "in", grids=True)
    inputs["searches"] = spark.createDataFrame([("白酒", date(2024, 3, 1), "q", "r")], "industry string, published date, search_query string, search_results string")
    how = stages.How(provider, str(tmp_path / "cache"), {"wait": 0.0, "tries": 1, "concurrency": 4})
    made = stages.run(spark, inputs, str(tmp_path / "work"), how=how)
    causes = {(r["stock_code"], r["indicator"]): r["probabilities"] for r in made["attribution"].collect()}
    assert causes["000006", "毛利率"] == {"原料涨价": 0.9, "其他": 0.1}
    assert {json.dumps(v, ensure_ascii=False) for (_, i), v in causes.items() if i == "存贷双高"} == {json.dumps({"行业特性": 1.0}, ensure_ascii=False)}
    got = {r["stock_code"]: json.loads(r["report"]) for r in made["reports"].collect()}
    assert got["000006"]["overall"]["final_score"] <= 100 and len(got) == 8
    assert got["000006"]["points"]["bear"] == ["毛利率低于同行（来源：C）"] and all("y" not in p for g in got.values() if "points" in g for p in g["points"]["bear"])
    asked = log.read_text().split()
    assert asked.count("a0_macro_search") == 1 and all(0 < asked.count(p) <= len(causes) for p in ("d1_hypothesis", "d1_lookup_notes"))  # equal questions once
    stages.run(spark, inputs, str(tmp_path / "other"), how=how)  # other frames, the same answers: only what failed is asked again
    assert log.read_text().split().count("d1_lookup_notes") == asked.count("d1_lookup_notes")


def test_rescoring_equals_a_whole_run(spark, tmp_path):
    from finsift.plans.incremental import reached, rescore

    names = ["Revenue_Total", "Cost_Revenue", "Gross_Profit", "Net_Profit", "Total_Assets", "Total_Liabilities", "Equity_Total", "Monetary_Funds", "Operating_Cash_Flow", "Operating_Cash_Inflow", "Interest_Debt"]
    schema = "stock_code string, industry string, year int, report_type string, standard_name string, value decimal(38,4)"

    def facts(companies, years, add=0):
        rows = []
        for n in companies:
            for y in years:
                values = [100 + y % 7 + n, 50 + n + add, 50 - n, 20 - n - add, 100, 60, 40 + 5 * (add > 50), 40, 5, 30, 40]
                rows += [(f"{n:06d}", "ab"[n % 2], y, GROUP, k, Decimal(v)) for k, v in zip(names, values, strict=True)]
                rows += [(f"{n:06d}", "ab"[n % 2], y, PARENT, "Monetary_Funds", Decimal(n + add))]
        return spark.createDataFrame(rows, schema)

    tags = spark.createDataFrame([(f"{n:06d}", "ab"[n % 2], f"t{n % 3}") for n in range(24)], "stock_code string, industry string, tag string")
    every = facts(range(24), range(2019, 2025))
    old = {"tags": tags} | stages.run(spark, {"facts": every, "tags": tags}, str(tmp_path / "a"), skip=("reports",))
    new = facts([3], [2021], 9).unionByName(facts([8], [2023], 60))  # the second fails the gate now
    changed = new.select("stock_code", "year").distinct()
    whole = every.join(changed, ["stock_code", "year"], "left_anti").unionByName(new)
    want = stages.run(spark, {"facts": whole, "tags": tags}, str(tmp_path / "b"), skip=("reports",))
    got = rescore(old, new)
    for name in ("scores", "outliers", "anomalies", "blocked"):
        assert sorted(got[name].collect(), key=str) == sorted(want[name].select(*got[name].columns).collect(), key=str), name
    again = {tuple(r) for r in got["rescored"].collect()}
    assert again == {tuple(r) for r in reached(changed, old["peers"]).collect()} and ("000003", 2022) in again and 2 < len(again) < 60
    assert sorted(got["scores"].collect(), key=str) != sorted(old["scores"].collect(), key=str)


def test_tables_that_meet_at_a_page_break_stay_apart(spark):
    from finsift.operators import documents

    h, g = ["项目", "期末"], ["名称", "数量"]
    pages = [
        (1, ["x", None, h, ["a", "1"], ["b", "2"]]), (2, [["c", "3"], ["d", "4"]]), (3, [h, ["e", "5"], None]),  # one table over three pages, its header again
        (4, [g, ["f", "6"]]), (5, [h, ["g", "7"]]),  # another header, and the first one's again: two tables
        (6, [["8", "甲"], ["9", "乙"]]), (7, [["k", "1", "2"]]), (8, [["l", "3", "4"]]), (10, [["m", "5", "6"]]), (11, [None, ["n", "7", "8"]]),
    ]
    rows, pos = [], 0
    for page, lines in pages:
        for line in lines:
            rows.append((1, page, pos, line if isinstance(line, list) else None))
            pos += 1
    rows += [(2, 1, 0, ["a", "1"]), (2, 2, 1, ["", "2"]), (3, 1, 0, None), (4, 1, 0, [])]
    got = documents.joined_tables(spark.createDataFrame(rows, "doc int, page int, pos int, cells array<string>"))
    by = {(r["doc"], r["page"]): r["table_id"] for r in got.collect()}
    assert [by[1, p] for p in (1, 2, 3, 4, 5, 6, 7, 8, 10, 11)] == [1, 1, 1, 2, 3, 4, 5, 5, 6, 7] and by[2, 1] == by[2, 2] == 1 and (3, 1) not in by
    assert got.count() == len([r for r in rows if r[3] is not None])
