"""The same queries in SQL, for comparison with another engine.  They restate the
semantics plainly (peers as pairs, medians as sorted lists) and share nothing with
the operators but the domain tables."""

from __future__ import annotations

import re

from finsift.plans.analog import INDICATORS, VARIANTS
from finsift.sources import config, prompts


def _values(rows, names: str) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names}))"


def _clamp(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(5.0::DOUBLE, {x})) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def _indicators(suffix: str, source: str) -> str:
    same = (("毛利率", "Gross_Profit", "Revenue_Total"), ("净利率", "Net_Profit", "Revenue_Total"), ("资产负债率", "Total_Liabilities", "Total_Assets"), ("存货周转率", "Cost_Revenue", "Inventory"), ("应收账款周转率", "Revenue_Total", "Receivables"), ("流动比率", "Current_Assets", "Current_Liabilities"))
    rows = [f"SELECT stock_code, industry, year, '{n}' AS indicator, {_ratio(a, b)} AS value FROM {source}" for n, a, b in same]
    rows += [f"SELECT stock_code, industry, year, '{n}', CASE WHEN y0 = year - 1 AND {c}0 > 0 THEN CAST({f} AS DOUBLE) / CAST({c}0 AS DOUBLE) - 1 END FROM grown_{suffix}" for n, f, c in (("营业收入增长率", "Revenue_Total", "r"), ("净利润增长率", "Net_Profit", "p"))]
    grown = f"grown_{suffix} AS (SELECT *, lag(year) OVER o AS y0, lag(Revenue_Total) OVER o AS r0, lag(Net_Profit) OVER o AS p0 FROM {source} WINDOW o AS (PARTITION BY stock_code ORDER BY year))"
    return f"{grown},\nind_{suffix} AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE value IS NOT NULL)"


_P = "l_extendedprice"
_D = "AS DECIMAL(18,4)"
_FIELD_ROWS = [(v, f, s, i) for f, s, names in config.FIELDS for i, v in enumerate(names)]
_TAG_ROWS = [(d, o) for d, options in config.SOFT_TAGS for o in options]
_MID = "({0}[(len({0}) - 1) // 2 + 1] + {0}[len({0}) // 2 + 1]) / 2"
BASE = f"""
WITH sums AS (SELECT l_suppkey AS n, CAST(year(l_shipdate) AS INT) AS year,
    sum(CAST({_P} * (1 - l_discount) {_D})) AS revenue, sum(CAST({_P} {_D})) AS gross, sum(CAST({_P} * l_tax * 5 {_D})) AS cost,
    sum(CAST(CASE WHEN l_returnflag = 'R' THEN {_P} ELSE 0 END {_D})) AS returned, sum(CAST(CASE WHEN l_linestatus = 'F' THEN {_P} ELSE 0 END {_D})) AS closed,
    sum(CAST(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN {_P} ELSE 0 END {_D})) AS parent_funds FROM lineitem GROUP BY 1, 2),
w AS (SELECT lpad(CAST(n AS VARCHAR), 6, '0') AS stock_code, CAST(s_nationkey AS VARCHAR) AS industry, year, n, revenue AS Revenue_Total, cost AS Cost_Revenue, revenue - cost AS Gross_Profit,
    revenue - cost - returned AS Net_Profit, gross * 2 AS Total_Assets, returned + cost AS Total_Liabilities, gross * 2 - returned - cost + CASE WHEN n % 7 = 0 THEN 5 ELSE 0 END AS Equity_Total,
    closed AS Monetary_Funds, revenue - cost - returned * 2 AS Operating_Cash_Flow, gross - returned * 2 AS Operating_Cash_Inflow, returned * 2 AS Interest_Debt,
    revenue AS Retained_Begin, revenue * 2 - cost * 2 - returned + CASE WHEN n % 7 = 0 THEN 5000 ELSE 0 END AS Retained_End, cost AS Dividends, returned AS Inventory, gross - closed AS Receivables, gross + closed AS Current_Assets, returned + closed AS Current_Liabilities, parent_funds
    FROM sums JOIN supplier ON n = s_suppkey),
good AS (SELECT * FROM w WHERE NOT coalesce(abs(Total_Assets - Total_Liabilities - Equity_Total) > 1, false)),
{_indicators("all", "w")},
{_indicators("good", "good")},
ind AS (SELECT * FROM ind_good),
co AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, CAST(s_nationkey AS VARCHAR) AS industry, s_suppkey AS n, s_acctbal AS a FROM supplier),
tags AS (SELECT stock_code, industry, '资产结构' AS dimension, CASE WHEN a < 0 THEN '轻资产' WHEN a < 5000 THEN '混合' ELSE '重资产' END AS value FROM co
    UNION ALL SELECT stock_code, industry, '客户类型', CASE WHEN n % 3 = 0 THEN 'To-B' WHEN n % 3 = 1 THEN 'To-C端' ELSE 'To-G' END FROM co
    UNION ALL SELECT stock_code, industry, '生命周期', CASE WHEN n % 11 = 0 THEN '未知' WHEN n % 2 = 0 THEN '成熟期' ELSE '成长期' END FROM co),
sets AS (SELECT stock_code, industry, list_sort(list(DISTINCT dimension || ':' || value)) AS t FROM tags GROUP BY ALL),
pairs AS (SELECT a.stock_code, b.stock_code AS peer_code, round(len(list_intersect(a.t, b.t)) / sqrt(CAST(len(a.t) * len(b.t) AS DOUBLE)), 9) AS similarity
    FROM sets a JOIN sets b ON a.industry = b.industry AND a.stock_code <> b.stock_code),
peers AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY stock_code ORDER BY similarity DESC, peer_code) AS INT) AS rank FROM pairs) WHERE rank <= 5),
pv AS (SELECT p.stock_code, year, indicator, list_sort(list(value)) AS l, len(list(value)) AS n_peers FROM peers p JOIN ind i ON i.stock_code = p.peer_code GROUP BY ALL),
med AS (SELECT *, {_MID.format("l")} AS median FROM pv),
devs AS (SELECT *, list_sort(list_transform(l, lambda v: abs(v - median))) AS d FROM med),
mads AS (SELECT *, {_MID.format("d")} AS mad FROM devs),
found0 AS (SELECT i.stock_code, i.year, i.indicator, value AS actual, median, mad, CAST(n_peers AS INT) AS n_peers, n_peers < 3 AS low_confidence, value > median AS above,
    CASE WHEN mad > 0 THEN (value - median) / mad WHEN value = median THEN 0.0 END AS signed, mad = 0 AND value <> median AS zero_mad FROM ind i JOIN mads USING (stock_code, year, indicator)),
found AS (SELECT *, abs(signed) AS multiple, CASE WHEN zero_mad OR abs(signed) > 5 THEN 'extreme' WHEN abs(signed) > 2 THEN 'abnormal' ELSE 'normal' END AS severity FROM found0),
outl AS (SELECT * FROM found WHERE severity <> 'normal'),
cr AS (SELECT stock_code, year, CASE WHEN Net_Profit > 0 THEN CAST(Operating_Cash_Flow AS DOUBLE) / CAST(Net_Profit AS DOUBLE) END AS r, {_ratio("Operating_Cash_Inflow", "Revenue_Total")} AS q FROM good),
cq AS (SELECT stock_code, year, '净现比/收现比' AS check_name, r, round(r, 6) AS value, 0.6 AS threshold FROM cr WHERE r < 0.6 AND q < 0.6),
cqs AS (SELECT *, CASE WHEN r < 0 THEN 5.0::DOUBLE ELSE {_clamp("round((0.6::DOUBLE - r) / 0.2::DOUBLE * 2, 6)")} END AS severity FROM cq),
dh AS (SELECT stock_code, year, '存贷双高' AS check_name, a * b AS r, round(a * b, 6) AS value, 0.3 AS threshold FROM (SELECT stock_code, year, {_ratio("Monetary_Funds", "Total_Assets")} AS a, {_ratio("Interest_Debt", "Total_Assets")} AS b FROM good) WHERE a > 0.3 AND b > 0.3),
dhs AS (SELECT *, CASE WHEN r > 0.3 THEN 5.0::DOUBLE WHEN r >= 0.1 THEN round(2 + (r - 0.1::DOUBLE) / 0.2::DOUBLE, 6) ELSE 1.0::DOUBLE END AS severity FROM dh),
gp AS (SELECT stock_code, year, '母子资金分离度' AS check_name, {_ratio("(Monetary_Funds - parent_funds)", "Total_Assets")} AS g, 0.15 AS threshold FROM good WHERE n % 4 <> 0),
gps AS (SELECT stock_code, year, check_name, round(g, 6) AS value, threshold, CASE WHEN g > 0.3 THEN 5.0 WHEN g > 0.15 THEN 3.0 ELSE 0.0 END AS severity FROM gp WHERE g > 0.15),
anom AS (SELECT stock_code, year, check_name, value, CAST(threshold AS DOUBLE) AS threshold, CAST(severity AS DOUBLE) AS severity FROM (SELECT * EXCLUDE r FROM cqs UNION ALL SELECT * EXCLUDE r FROM dhs UNION ALL SELECT * FROM gps)),
paths0 AS (SELECT stock_code, year, indicator, 'C' AS source FROM outl UNION ALL SELECT stock_code, year, check_name, 'B+' FROM anom),
paths1 AS (SELECT *, CAST(stock_code AS INT) + year AS k FROM paths0),
paths AS (SELECT *, CASE WHEN k % 3 = 0 THEN '经营恶化' WHEN k % 3 = 1 THEN NULL ELSE '战略备货' END AS p1, CASE WHEN k % 2 = 0 THEN '行业特性' ELSE '经营改善' END AS p2, k % 5 = 0 AS vague, k % 7 = 0 AS conflict FROM paths1),
attr0 AS (SELECT stock_code, year, indicator, source, unnest(CASE
    WHEN p1 IS NULL AND source = 'B+' AND p2 = '行业特性' THEN [{{'cause': p2, 'p': 1.0::DOUBLE}}]
    WHEN p1 IS NULL THEN [{{'cause': p2, 'p': 0.8::DOUBLE}}, {{'cause': '其他', 'p': 0.2::DOUBLE}}]
    WHEN NOT vague AND NOT conflict THEN [{{'cause': p1, 'p': 0.7::DOUBLE}}, {{'cause': p2, 'p': 0.1::DOUBLE}}, {{'cause': '其他', 'p': 0.2::DOUBLE}}]
    ELSE [{{'cause': p1, 'p': 0.4::DOUBLE}}, {{'cause': p2, 'p': 0.4::DOUBLE}}, {{'cause': '其他', 'p': 0.2::DOUBLE}}] END) AS e FROM paths),
attr AS (SELECT stock_code, year, indicator, source, e.cause AS cause, e.p AS p, cause_weight FROM attr0 LEFT JOIN {_values(config.CAUSES, "cn, cause_weight")} ON cn = e.cause),
wd0 AS (SELECT o.*, cap, CASE WHEN above = (direction = 'positive') THEN abs(base_weight) ELSE -abs(base_weight) END::DOUBLE AS weight, CASE WHEN zero_mad THEN 3 * (cap - 1) ELSE multiple END::DOUBLE AS m
    FROM outl o JOIN {_values(config.INDICATORS, "indicator, category, base_weight, direction, cap")} USING (indicator)),
wd AS (SELECT *, least(1 + m / 3, cap)::DOUBLE AS amp FROM wd0),
ci0 AS (SELECT stock_code, year, indicator, sum(CAST(round(p * coalesce(cause_weight, weight) * amp, 6) AS DECIMAL(38,6))) AS expected, any_value(m) AS m FROM wd JOIN (SELECT * FROM attr WHERE source = 'C') USING (stock_code, year, indicator) GROUP BY ALL),
ci AS (SELECT stock_code, year, indicator, CAST(expected AS DOUBLE) AS expected, round(CAST(expected AS DOUBLE) * m, 6) AS impact FROM ci0),
be AS (SELECT stock_code, year, indicator AS check_name, sum(CAST(round(p * coalesce(cause_weight, -3.0), 6) AS DECIMAL(38,6))) AS expected FROM attr WHERE source = 'B+' GROUP BY ALL),
bi AS (SELECT stock_code, year, check_name, round(coalesce(CAST(expected AS DOUBLE), -3.0) * severity, 6) AS impact FROM anom LEFT JOIN be USING (stock_code, year, check_name)),
ev AS (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN '强烈看好该公司' WHEN event_id % 5 = 1 THEN '{config.NO_FACTS}' WHEN event_id % 5 = 2 THEN '推荐买入' ELSE '价格上涨 ' || event_type END AS text FROM events),
raw0 AS (SELECT stock_code, year, n, Revenue_Total AS v, CASE WHEN n % 3 = 0 THEN '营业收入' WHEN n % 3 = 1 THEN '营业总收入' ELSE '营收 ' END AS raw_name FROM w
    UNION ALL SELECT stock_code, year, n, Net_Profit, CASE WHEN n % 3 = 0 THEN '净利润' WHEN n % 3 = 1 THEN '归母净利润' ELSE '盈利' END FROM w
    UNION ALL SELECT stock_code, year, n, Total_Assets, CASE WHEN n % 3 = 1 THEN '总资产' ELSE '资产总计' END FROM w),
raw AS (SELECT stock_code, year, raw_name, CASE WHEN n % 13 = 5 THEN '—' WHEN v < 0 THEN '(' || CAST(CAST(abs(v) AS DECIMAL(38,4)) AS VARCHAR) || ')' ELSE ' ' || CAST(CAST(v AS DECIMAL(38,4)) AS VARCHAR) END AS text,
    CASE WHEN n % 5 = 0 THEN '元' WHEN n % 4 = 0 THEN '元' WHEN n % 4 = 1 THEN '千元' WHEN n % 4 = 2 THEN '万元' ELSE '美元' END AS unit, CASE WHEN n % 13 = 5 THEN NULL ELSE v END AS parsed FROM raw0),
conv AS (SELECT stock_code, year, raw_name, text, unit, parsed, CAST(parsed * CASE unit WHEN '元' THEN 1 WHEN '千元' THEN 1000 WHEN '万元' THEN 10000 END AS DOUBLE) AS value,
    CASE WHEN parsed IS NULL THEN 'text' WHEN unit = '美元' THEN 'unit' END AS reason FROM raw),
dict AS {_values(_FIELD_ROWS, "raw_name, standard_name, statement, priority")},
dl AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS pos FROM documents WHERE text IS NOT NULL)
"""
_BALANCE = "SELECT stock_code, year, CAST(Total_Assets AS DOUBLE) AS lhs, CAST(Total_Liabilities + Equity_Total AS DOUBLE) AS rhs, CAST(abs(Total_Assets - Total_Liabilities - Equity_Total) AS DOUBLE) AS diff, abs(Total_Assets - Total_Liabilities - Equity_Total) <= 1 AS ok FROM w"
_GRID = """, x AS (SELECT *, stock_code || '_' || year AS doc, CASE WHEN n % 5 = 0 THEN '千元' WHEN n % 7 = 3 THEN '万元' ELSE '元' END AS u0, CASE WHEN n % 7 = 3 THEN '万元' ELSE '元' END AS u1,
    CASE WHEN n % 4 = 1 THEN '母公司报表' ELSE '合并报表' END AS t0, CASE WHEN n % 3 = 0 THEN 2 ELSE 3 END AS ec, CASE WHEN n % 3 = 0 THEN 3 ELSE 1 END AS bc FROM w),
fields AS (SELECT x.*, unnest([{'t': 0, 'r': 2, 'raw': '资产总计', 's': 'Total_Assets', 'u': u0, 'k': t0, 'a': Total_Assets, 'b': Total_Liabilities}, {'t': 0, 'r': 3, 'raw': '负债合计', 's': 'Total_Liabilities', 'u': u0, 'k': t0, 'a': Total_Liabilities, 'b': Total_Assets},
    {'t': 0, 'r': 4, 'raw': '未分配利润', 's': 'Retained_End', 'u': '元', 'k': t0, 'a': Retained_End, 'b': Retained_Begin}, {'t': 1, 'r': 1, 'raw': '净利润', 's': 'Net_Profit', 'u': u1, 'k': '合并报表', 'a': Net_Profit, 'b': Revenue_Total},
    {'t': 1, 'r': 2, 'raw': '利润分配', 's': 'Dividends', 'u': u1, 'k': '合并报表', 'a': Dividends, 'b': NULL}]) AS f FROM x),
placed AS (SELECT stock_code, year, n, doc, f.t AS table_id, f.r AS row, f.raw AS raw_name, f.s AS standard_name, f.u AS unit, f.k AS report_type,
    unnest([{'c': CASE WHEN f.t = 0 THEN ec ELSE 1 END, 'p': CASE WHEN f.t = 0 THEN 'end_balance' ELSE 'year' END, 'v': f.a}, {'c': CASE WHEN f.t = 0 THEN bc ELSE 2 END, 'p': CASE WHEN f.t = 0 THEN 'begin_balance' ELSE 'previous_year' END, 'v': f.b}]) AS p FROM fields),
cell AS (SELECT * EXCLUDE p, p.c AS col, p.p AS role, CASE WHEN table_id = 0 AND row = 3 AND n % 13 = 5 THEN NULL ELSE round(CAST(p.v AS DECIMAL(38,4)), 2) END AS parsed FROM placed),
gf AS (SELECT *, CAST(parsed * CASE unit WHEN '元' THEN 1 WHEN '千元' THEN 1000 ELSE 10000 END AS DECIMAL(38,4)) AS value FROM cell)"""
_LETTERS = "".join(sorted({c for _, _, names in config.FIELDS for v in names for c in v}))
_PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c) not in "'\\")[: len(_LETTERS)]
_MEANS = " AND ".join([*(f"(NOT contains(name, '{q}') OR contains(d.raw_name, '{q}'))" for q in config.QUALIFIERS), *(f"(NOT contains(d.raw_name, '{q}') OR contains(name, '{q}'))" for q in config.MARKERS)])
# edits are counted in bytes there: each letter of the vocabulary becomes a byte of its own, any other one more
_NEAR = rf""", oc AS (SELECT o_orderkey, {[*VARIANTS]}[o_custkey % {len(VARIANTS)} + 1] AS raw_name FROM orders),
un AS (SELECT trim(raw_name) AS raw_name, count(*) AS n_rows FROM oc WHERE trim(raw_name) NOT IN (SELECT raw_name FROM dict) GROUP BY 1),
cl AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_name, '[ 　	]', '', 'g'), '^([一二三四五六七八九十]+、|[（(][一二三四五六七八九十]+[）)]|[0-9]+[、.])', ''), '^(其中|减|加)[:：]', ''), '[（(][^（()）]*[）)]$', '') AS name FROM un),
al AS (SELECT c.raw_name, d.raw_name AS known, standard_name, statement, priority, round(1 - CAST(levenshtein(translate(regexp_replace(name, '[^{_LETTERS}]', '~', 'g'), '{_LETTERS}', '{_PLAIN}'), translate(d.raw_name, '{_LETTERS}', '{_PLAIN}')) AS DOUBLE) / greatest(length(name), length(d.raw_name)), 9) AS confidence FROM cl c, dict d WHERE {_MEANS}),
tp AS (SELECT *, max(confidence) OVER (PARTITION BY raw_name) AS m FROM al WHERE confidence >= 0.666666667),
su AS (SELECT * FROM tp WHERE confidence = m AND raw_name IN (SELECT raw_name FROM tp WHERE confidence = m GROUP BY 1 HAVING count(DISTINCT standard_name) = 1) QUALIFY row_number() OVER (PARTITION BY raw_name ORDER BY priority, known) = 1)"""
_RD = "abs(Retained_End - Retained_Begin - Net_Profit + Dividends)"
_RETAINED = f"SELECT stock_code, year, CAST(Retained_End AS DOUBLE) AS lhs, CAST(Retained_Begin + Net_Profit - Dividends AS DOUBLE) AS rhs, CAST({_RD} AS DOUBLE) AS diff, CASE WHEN {_RD} = 0 THEN true WHEN Retained_End = 0 THEN NULL ELSE CAST({_RD} AS DOUBLE) / abs(CAST(Retained_End AS DOUBLE)) <= 1e-3 END AS ok FROM w"
_A = "stock_code, year, check_name, value, threshold, severity"
_HYP = prompts.TEMPLATES["d1_hypothesis"].replace("'", "''").replace("{{macro_facts}}", "无")
_TABLE = "SELECT *, CAST(sum(CAST(is_new AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS INT) AS table_id FROM (SELECT *, inn AND NOT coalesce(lag(inn) OVER (PARTITION BY doc ORDER BY pos), false) AS is_new FROM (SELECT *, {0} AS inn FROM dl))"
_SCORED = """, c AS (SELECT stock_code, year, CAST(sum(CAST(impact AS DECIMAL(38,6))) AS DOUBLE) AS x FROM ci GROUP BY ALL), b AS (SELECT stock_code, year, CAST(sum(CAST(impact AS DECIMAL(38,6))) AS DOUBLE) AS x FROM bi GROUP BY ALL), f AS (SELECT stock_code, year, coalesce(c.x, 0) AS c_impact, coalesce(b.x, 0) AS bplus_impact FROM good LEFT JOIN c USING (stock_code, year) LEFT JOIN b USING (stock_code, year)), g AS (SELECT *, round(100 + c_impact + bplus_impact, 6) AS raw_score FROM f), h AS (SELECT *, greatest(0.0, least(100.0, raw_score)) AS final_score FROM g), scored AS (SELECT *, CASE WHEN final_score >= 90 THEN 'high' WHEN final_score >= 60 THEN 'medium' ELSE 'low' END AS tier FROM h)"""
_SQL = {
    "indicator_long": "SELECT stock_code, industry, year, indicator, round(value, 6) AS value FROM ind",
    "indicator_pivot": "SELECT stock_code, year, " + ", ".join(f"round(max(CASE WHEN indicator = '{n}' THEN signed END), 6) AS i{i}" for i, n in enumerate(INDICATORS)) + " FROM found GROUP BY ALL",
    "growth": "SELECT stock_code, year, indicator, round(value, 6) AS value FROM ind WHERE indicator IN ('营业收入增长率', '净利润增长率')",
    "peer_candidates": "SELECT stock_code, count(*) OVER (PARTITION BY industry) - 1 AS n_candidates FROM co",
    "peer_similarity": "SELECT DISTINCT a.industry, array_to_string(a.t, '|') AS tags_a, array_to_string(b.t, '|') AS tags_b, round(len(list_intersect(a.t, b.t)) / sqrt(CAST(len(a.t) * len(b.t) AS DOUBLE)), 9) AS similarity FROM sets a JOIN sets b ON a.industry = b.industry",
    "peer_topk": "SELECT stock_code, peer_code, similarity, rank FROM peers",
    "peer_median": "SELECT stock_code, year, indicator, CAST(n_peers AS INT) AS n_peers, round(median, 6) AS peer_median FROM med",
    "historical_mean": f", b AS ({_BALANCE}), x AS (SELECT i.*, CASE WHEN b.ok IS NULL THEN value END AS v FROM ind_all i LEFT JOIN (SELECT * FROM b WHERE NOT ok AND year % 2 = 0) b USING (stock_code, year)) SELECT stock_code, year, indicator, round(value, 6) AS value, round(avg(v) OVER p, 6) AS historical_mean, count(v) OVER p AS n_years FROM x WINDOW p AS (PARTITION BY stock_code, indicator ORDER BY year RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)",
    "mad": "SELECT stock_code, year, indicator, round(mad, 6) AS mad FROM found",
    "deviation_multiple": "SELECT stock_code, year, indicator, round(actual, 6) AS actual, round(median, 6) AS median, round(multiple, 6) AS multiple, round(signed, 6) AS signed, zero_mad, n_peers, low_confidence FROM found",
    "deviation_graded": "SELECT stock_code, year, indicator, round(multiple, 6) AS multiple, severity FROM outl",
    "deviation_text": "SELECT stock_code, year, indicator, CASE WHEN above THEN '高于' ELSE '低于' END || CASE WHEN zero_mad THEN '同行中位数（同行无差异）' ELSE '同行中位数 ' || CAST(CAST(round(multiple, 1) AS DECIMAL(20,1)) AS VARCHAR) || '倍 MAD' END AS summary FROM found",
    "numeric_parse": "SELECT stock_code, year, text, CAST(parsed AS DOUBLE) AS value FROM conv",
    "unit_convert": "SELECT stock_code, year, raw_name, unit, value, reason FROM conv",
    "field_mapping": "SELECT stock_code, year, trim(raw.raw_name) AS raw_name, standard_name, statement, priority FROM raw LEFT JOIN dict ON trim(raw.raw_name) = dict.raw_name",
    "unmapped_fields": "SELECT trim(raw_name) AS raw_name, count(*) AS n_rows FROM raw WHERE trim(raw_name) NOT IN (SELECT raw_name FROM dict) GROUP BY 1",
    "field_priority": ", every AS (SELECT * FROM conv UNION ALL SELECT * REPLACE ('销售收入' AS raw_name) FROM conv WHERE raw_name = '营业收入'), r AS (SELECT stock_code, year, standard_name, dict.raw_name, value, row_number() OVER (PARTITION BY stock_code, year, standard_name ORDER BY priority, dict.raw_name, value NULLS FIRST) AS k FROM every JOIN dict ON trim(every.raw_name) = dict.raw_name) SELECT stock_code, year, standard_name, raw_name, value FROM r WHERE k = 1",
    "cell_fetch": ", c AS (SELECT l_orderkey AS doc, l_linenumber AS row, unnest([l_quantity, l_discount, l_tax]) AS cell, unnest([0, 1, 2]) AS col FROM lineitem), g AS (SELECT o_orderkey AS doc, CAST(o_orderkey % 4 + 1 AS INT) AS row, CAST(o_custkey % 3 AS INT) AS col, CASE WHEN o_custkey % 3 = 0 THEN 'end_balance' WHEN o_custkey % 3 = 1 THEN 'begin_balance' ELSE 'percentage' END AS role FROM orders) SELECT doc, row, col, role, cell FROM c JOIN g USING (doc, row, col)",
    "balance_check": _BALANCE,
    "retained_rollforward": _RETAINED,
    "validation_record": f", b AS ({_BALANCE}), r AS ({_RETAINED}), e AS (SELECT stock_code, year, 'balance' AS name, diff, ok FROM b UNION ALL SELECT stock_code, year, 'retained', diff, ok FROM r) SELECT stock_code, year, bool_and(coalesce(ok, true)) OVER (PARTITION BY stock_code, year) AS passed, name, round(diff, 6) AS diff, ok FROM e",
    "blocked_union": f", b AS ({_BALANCE}) SELECT stock_code, year, CASE WHEN ok THEN 'ok' ELSE '{config.BLOCKED}' END AS message FROM b",
    "cash_quality": f"SELECT {_A} FROM anom WHERE check_name = '净现比/收现比'",
    "cash_levels": ", u AS (SELECT stock_code, year, 'cash_to_profit' AS ratio, r AS value, 0.0 AS severe, 2.0 AS high FROM cr UNION ALL SELECT stock_code, year, 'cash_to_revenue', q, 0.3, 1.5 FROM cr) SELECT stock_code, year, ratio, round(value, 6) AS value, CASE WHEN value < severe THEN 'severe' WHEN value < 0.6 THEN 'low' WHEN value > high THEN 'high' ELSE 'normal' END AS level FROM u WHERE value IS NOT NULL",
    "dual_high": f"SELECT {_A} FROM anom WHERE check_name = '存贷双高'",
    "parent_gap": f"SELECT {_A} FROM anom WHERE check_name = '母子资金分离度'",
    "logic_anomalies": "SELECT stock_code, year, string_agg(check_name, '|' ORDER BY check_name) AS checks FROM anom GROUP BY ALL",
    "anomalous_companies": "SELECT stock_code, industry FROM co WHERE stock_code IN (SELECT stock_code FROM anom)",
    "reasoning_rules": "SELECT stock_code, year, indicator, source, cause, p FROM attr",
    "probability_check": ", t AS (SELECT stock_code, year, indicator, source, sum(p) AS s, max(CASE WHEN cause = '其他' THEN p ELSE 0 END) AS o, count(*) AS n FROM attr GROUP BY ALL), u AS (SELECT *, CASE WHEN CAST(stock_code AS INT) % 9 = 0 THEN 0.1 ELSE 0 END AS e FROM t) SELECT stock_code, year, indicator, source, abs(s + n * e - 1) < 1e-9 AND (o + CASE WHEN o > 0 THEN e ELSE 0 END <= 0.2 + 1e-9 OR n = 1) AS valid FROM u",
    "attribution_line": "SELECT stock_code, year, source, indicator || ' => 归因：' || string_agg(cause || '(' || CAST(CAST(round(p * 100) AS INT) AS VARCHAR) || '%)', '，' ORDER BY p DESC, cause) AS line FROM attr GROUP BY stock_code, year, source, indicator",
    "effective_weight": "SELECT stock_code, year, indicator, weight, round(weight * amp, 6) AS effective_weight FROM wd",
    "c_deduction": "SELECT * FROM ci",
    "bplus_deduction": "SELECT * FROM bi",
    "final_score": f"{_SCORED} SELECT * FROM scored",
    "report_json": f"""{_SCORED}, i AS (SELECT stock_code, year, indicator AS name, 'C' AS source, impact FROM ci UNION ALL SELECT stock_code, year, check_name, 'B+', impact FROM bi),
        items AS (SELECT stock_code, year, 'C' AS source, indicator AS name, severity, round(actual, 6) AS value FROM outl UNION ALL SELECT stock_code, year, 'B+', check_name, CASE WHEN severity >= 5 THEN 'extreme' ELSE 'abnormal' END, value FROM anom),
        leaf AS (SELECT stock_code, year, 'overall' AS module, 'score' AS item, final_score AS value, tier AS text FROM scored
        UNION ALL SELECT stock_code, year, 'overall', 'C', c_impact, NULL FROM scored
        UNION ALL SELECT stock_code, year, 'overall', 'B+', bplus_impact, NULL FROM scored
        UNION ALL SELECT s.stock_code, year, 'peer', peer_code, similarity, NULL FROM scored s JOIN peers USING (stock_code)
        UNION ALL SELECT stock_code, year, 'anomaly', source || ':' || name, value, severity FROM items
        UNION ALL SELECT stock_code, year, 'cause', source || ':' || indicator || ':' || cause, p, NULL FROM attr
        UNION ALL SELECT stock_code, year, CASE WHEN impact > 0 THEN 'bull' ELSE 'bear' END, name, NULL, source FROM i WHERE impact <> 0
        UNION ALL SELECT stock_code, year, 'blocked', 'message', NULL, '{config.BLOCKED}' FROM w WHERE (stock_code, year) NOT IN (SELECT (stock_code, year) FROM good))
        SELECT stock_code, year, module, item, round(CAST(value AS DOUBLE), 6) AS value, text FROM leaf""",
    "report_rows": "SELECT stock_code, year, 'C' AS source, indicator AS name, severity, round(actual, 6) AS value FROM outl UNION ALL SELECT stock_code, year, 'B+', check_name, CASE WHEN severity >= 5 THEN 'extreme' ELSE 'abnormal' END, value FROM anom",
    "report_points": ", i AS (SELECT stock_code, year, indicator AS name, impact FROM ci UNION ALL SELECT stock_code, year, check_name, impact FROM bi) SELECT stock_code, year, CASE WHEN impact > 0 THEN 'bull' ELSE 'bear' END AS side, name FROM i WHERE impact <> 0",
    "section_flatten": "SELECT conv_id AS doc, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, role AS title, CAST(length(text) AS INT) AS size, CAST(turn AS INT) AS page_number FROM conversations",
    "chunk_forward_fill": "SELECT doc, pos, coalesce(last_value(CASE WHEN length(line) BETWEEN 1 AND 20 THEN line END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS block FROM dl",
    "table_merge": f", t AS ({_TABLE.format("contains(line, '|')")}) SELECT doc, table_id, count(*) AS n_rows, min(pos) AS first_pos FROM t WHERE inn GROUP BY ALL",
    "table_join": """, li AS (SELECT l_orderkey, l_linenumber, x.* FROM (SELECT l_orderkey, l_linenumber, min({'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_quantity': l_quantity, 'l_returnflag': l_returnflag, 'l_linestatus': l_linestatus}) AS x FROM lineitem GROUP BY 1, 2)),
        r0 AS (SELECT l_orderkey AS doc, CAST((l_linenumber - 1) // 2 AS INT) AS page, CAST(l_linenumber AS INT) AS pos, l_partkey % 11 <> 0 AS inn, CASE WHEN l_returnflag = 'A' THEN l_linestatus ELSE CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) END AS c,
        l_suppkey % 5 = 0 AS wide, l_orderkey % 3 = 0 AND (l_linenumber - 1) % 2 = 0 AS hd, l_linenumber = 5 AS g FROM li),
        r1 AS (SELECT doc, page, pos, inn, CASE WHEN hd THEN ['h', CASE WHEN g THEN 'g' ELSE 'h' END] WHEN wide THEN ['a', c, ''] ELSE ['a', c] END AS cells FROM r0),
        r2 AS (SELECT *, list_transform(cells, lambda x: CASE WHEN x = '' THEN '-' WHEN regexp_full_match(x, '[0-9]+') THEN 'n' ELSE 't' END) AS kinds, coalesce(lag(inn) OVER o, false) AS before, lag(page) OVER o AS page0 FROM r1 WINDOW o AS (PARTITION BY doc ORDER BY pos)),
        r3 AS (SELECT *, inn AND (NOT before OR page0 <> page) AS start, before AND page0 = page - 1 AS touches FROM r2),
        r4 AS (SELECT *, sum(CAST(start AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS part, start AND list_contains(kinds, 't') AND NOT list_contains(kinds, 'n') AS headed FROM r3),
        r5 AS (SELECT * FROM r4 WHERE inn),
        pt AS (SELECT doc, part, max(len(cells)) AS width, max(CASE WHEN headed THEN array_to_string(cells, '|') END) AS head, bool_or(start AND coalesce(touches, false)) AS touches FROM r5 GROUP BY ALL),
        ck AS (SELECT doc, part, col, min(kind) AS kind FROM (SELECT doc, part, unnest(kinds) AS kind, unnest(range(len(kinds))) AS col FROM r5 WHERE NOT headed) WHERE kind <> '-' GROUP BY ALL HAVING min(kind) = max(kind)),
        un AS (SELECT DISTINCT a.doc, a.part FROM ck a JOIN ck b ON a.doc = b.doc AND a.col = b.col AND b.part = a.part - 1 AND a.kind <> b.kind),
        p2 AS (SELECT *, lag(width) OVER o AS width0, last_value(head IGNORE NULLS) OVER (PARTITION BY doc ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head0 FROM pt WINDOW o AS (PARTITION BY doc ORDER BY part)),
        p3 AS (SELECT p2.doc, p2.part, sum(CASE WHEN touches AND width = width0 AND un.part IS NULL AND (head IS NULL OR coalesce(head = head0, false)) THEN 0 ELSE 1 END) OVER (PARTITION BY p2.doc ORDER BY p2.part) AS table_id FROM p2 LEFT JOIN un ON un.doc = p2.doc AND un.part = p2.part)
        SELECT doc, page, pos, CAST(table_id AS INT) AS table_id FROM r5 JOIN p3 USING (doc, part)""",
    "row_dedup": f", t AS ({_TABLE.format('length(line) > 0')}) SELECT doc, table_id, min(pos) AS pos FROM t WHERE inn GROUP BY doc, table_id, line",
    "text_cap": "SELECT doc, pos FROM dl WHERE length(line) > 50",
    "document_completeness": ", c AS (SELECT page_id AS doc, length(html) > 0 AS readable, contains(html, '<table') AS has_tables, contains(html, '<article') AS has_discussion, contains(html, '<footer') AS has_notes FROM pages) SELECT *, readable AND has_tables AND has_discussion AND has_notes AS complete FROM c",
    "opinion_filter": "SELECT event_id, text FROM ev WHERE NOT regexp_matches(text, '" + "|".join(config.OPINIONS) + "')",
    "sentinel_null": f"SELECT event_id, nullif(text, '{config.NO_FACTS}') AS text FROM ev",
    "tag_violations": f", a AS (SELECT stock_code, dimension, coalesce(v, value) AS value FROM tags LEFT JOIN {_values(config.TAG_ALIASES, 'alias, v')} ON alias = value) SELECT * FROM a WHERE (dimension, value) NOT IN {_values(_TAG_ROWS, 'd, o')}",
    "relevant_sections": ", t AS (SELECT conv_id * 1000 + turn AS key, lower(text) AS text FROM conversations UNION ALL SELECT -s_suppkey, lower(CASE WHEN s_suppkey % 2 = 0 THEN '本期毛利率下降，' ELSE '本期资产负债率上升，' END || s_name) FROM supplier) SELECT key, i AS indicator, count(*) AS hits FROM t JOIN (VALUES ('the', '毛利率'), ('of', '毛利率'), ('that', '净利率'), ('with', '资产负债率'), ('毛利率', '毛利率'), ('负债', '资产负债率')) AS k(w, i) ON contains(text, w) GROUP BY ALL",
    "evidence": """, q AS (SELECT stock_code, year, indicator FROM outl UNION ALL SELECT stock_code, year, check_name FROM anom),
        t AS (SELECT stock_code, s_suppkey AS n, unnest(CASE WHEN s_suppkey % 3 = 0 THEN [{'i': '毛利率', 't': '本期毛利率受多种因素影响。', 'v': true}] ELSE [{'i': '毛利率', 't': '本期毛利率随产品结构变化。', 'v': false}, {'i': '资产负债率', 't': '资产负债率因借款上升！', 'v': false}] END) AS e FROM co JOIN supplier ON s_suppkey = co.n WHERE s_suppkey % 2 = 0)
        SELECT q.stock_code, year, indicator, e.t AS summary, e.t AS source_text, CAST(n % 200 AS INT) AS page_number, e.v AS is_vague FROM q JOIN t ON q.stock_code = t.stock_code AND e.i = indicator WHERE year BETWEEN 1990 AND 2010""",
    "part_forward_fill": ", h AS (SELECT doc, pos, CASE length(line) % 9 WHEN 0 THEN 'company_overview' WHEN 1 THEN 'financial_data' WHEN 2 THEN 'management_discussion' WHEN 3 THEN 'footnotes' END AS p FROM dl) SELECT doc, pos, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS part FROM h",
    "extracted_facts": ", f AS (SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN ['价格上涨 ' || event_type, '产量持平'] WHEN event_id % 3 = 1 THEN ['价格下跌 ' || event_type, '产量持平'] ELSE [] END) AS fact, CAST(unnest(CASE WHEN event_id % 3 = 2 THEN [] ELSE [0, 1] END) AS INT) AS pos FROM events) SELECT * FROM f",
    "dual_path_answers": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS summary, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 90 AS INT) END AS page_number, CASE WHEN event_id % 4 <> 0 THEN event_id % 5 = 0 END AS is_vague, CAST(least(4, event_id % 7) AS INT) AS n_hypotheses, (event_id % 3 = 0) <> (event_id % 2 = 0) AS valid, CASE WHEN (event_id % 3 = 0) <> (event_id % 2 = 0) THEN CASE WHEN event_id % 3 = 0 THEN 0.4 ELSE 0.3 END END::DOUBLE AS share FROM events",
    "fenced_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
    "prompt_render": f"SELECT stock_code, year, indicator, replace(replace(replace('{_HYP}', '{{{{indicator}}}}', indicator), '{{{{deviation}}}}', severity), '{{{{industry_tags}}}}', stock_code) AS prompt FROM outl",
    "llm_cache_misses": ", c AS (SELECT DISTINCT 'd1_hypothesis' AS prompt_name, event_type || ' ' || CAST(event_id % 50 AS VARCHAR) AS variables FROM events) SELECT sha256(prompt_name || chr(10) || variables) AS cache_key, prompt_name, variables FROM c WHERE NOT starts_with(variables, 'click')",
    "pdf_names": "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS stock_code, CAST(year(o_orderdate) AS INT) AS year FROM orders",
    "unprocessed_files": "SELECT stock_code, year FROM w WHERE year % 2 <> 0",
    "benchmark_facts": "SELECT industry, year, indicator, count(*) AS n, min(round(value, 6)) AS least, max(round(value, 6)) AS most FROM ind GROUP BY ALL",
    "header_roles": _GRID + " SELECT doc, table_id, row, col, role, raw_name, standard_name, unit, report_type FROM cell",
    "grid_facts": _GRID + " SELECT stock_code, year, report_type, standard_name, role, CAST(value AS DOUBLE) AS value, CASE WHEN parsed IS NULL THEN 'text' END AS reason FROM gf WHERE role <> 'previous_year' OR standard_name <> 'Dividends'",
    "grid_rollforward": _GRID + """, r AS (SELECT stock_code, year, max(CASE WHEN standard_name = 'Retained_End' AND role = 'end_balance' THEN value END) AS e, max(CASE WHEN standard_name = 'Retained_End' AND role = 'begin_balance' THEN value END) AS b,
        max(CASE WHEN standard_name = 'Net_Profit' AND role = 'year' THEN value END) AS p, max(CASE WHEN standard_name = 'Dividends' AND role = 'year' THEN value END) AS v FROM gf GROUP BY ALL)
        SELECT stock_code, year, CAST(e AS DOUBLE) AS lhs, CAST(b + p - v AS DOUBLE) AS rhs, CAST(abs(e - b - p + v) AS DOUBLE) AS diff, CASE WHEN e = b + p - v THEN true WHEN e = 0 THEN NULL ELSE CAST(abs(e - b - p + v) AS DOUBLE) / abs(CAST(e AS DOUBLE)) <= 1e-3 END AS ok FROM r""",
    "alias_suggestions": _NEAR + " SELECT raw_name, n_rows, standard_name, known, round(confidence, 6) AS confidence FROM un LEFT JOIN su USING (raw_name)",
    "alias_mapping": _NEAR + " SELECT o_orderkey, trim(oc.raw_name) AS raw_name, coalesce(dict.standard_name, su.standard_name) AS standard_name, coalesce(dict.statement, su.statement) AS statement FROM oc LEFT JOIN dict ON dict.raw_name = trim(oc.raw_name) LEFT JOIN su ON su.raw_name = trim(oc.raw_name) AND su.confidence >= 0.8",
    "prompt_tagging": ", o AS (SELECT industry, dimension, list_sort(list(DISTINCT value)) AS v FROM tags GROUP BY ALL), l AS (SELECT industry, string_agg(chr(10) || dimension || ': ' || array_to_string(v, ', '), '' ORDER BY dimension) AS t FROM o GROUP BY 1) SELECT stock_code, 'Tag ' || stock_code || ' (' || CASE WHEN n % 2 = 0 THEN industry ELSE '' END || ') with one third-level industry and one listed option of each dimension:' || t || chr(10) || 'Answer JSON with hard_tag and soft_tags.' AS prompt FROM co JOIN l USING (industry)",
    "answer_violations": """, e AS (SELECT event_id, event_type AS t, CAST(json_extract(props, '$.k') AS INT) AS k, event_id % 4 AS m, event_id % 5 AS z FROM events),
        i AS (SELECT event_id, k, unnest(range(z + 1)) AS i FROM e WHERE event_id % 11 <> 0)
        SELECT event_id, '$' AS path, 'json' AS fault FROM e WHERE event_id % 11 = 0
        UNION ALL SELECT event_id, '$.event', 'enum' FROM e WHERE event_id % 11 <> 0 AND t NOT IN ('click', 'view', 'purchase', 'error')
        UNION ALL SELECT event_id, '$.event', 'maxLength' FROM e WHERE event_id % 11 <> 0 AND length(t) > 5
        UNION ALL SELECT event_id, '$.k', CASE m WHEN 1 THEN 'missing' ELSE 'type' END FROM e WHERE event_id % 11 <> 0 AND m IN (1, 2)
        UNION ALL SELECT event_id, '$.k', CASE WHEN k < 10 THEN 'minimum' ELSE 'maximum' END FROM e WHERE event_id % 11 <> 0 AND m NOT IN (1, 2) AND (k < 10 OR k > 80)
        UNION ALL SELECT event_id, '$.tags', 'maxItems' FROM e WHERE event_id % 11 <> 0 AND z >= 3
        UNION ALL SELECT event_id, '$.tags[' || i || '].n', CASE WHEN i % 3 = 2 THEN 'missing' ELSE 'maximum' END FROM i WHERE i % 3 = 2 OR k + i > 50""",
    "config_tables": f", seen AS (SELECT indicator, count(*) AS n_values, count(DISTINCT stock_code) AS n_companies FROM ind GROUP BY 1) SELECT indicator, category, CAST(base_weight AS DOUBLE) AS base_weight, CASE WHEN direction = 'positive' THEN 1 ELSE -1 END AS sign, CAST(cap AS DOUBLE) AS cap, n_values, n_companies FROM {_values(config.INDICATORS, 'indicator, category, base_weight, direction, cap')} LEFT JOIN seen USING (indicator)",
}
ORACLE_SQL = {k: BASE + v for k, v in _SQL.items()}
# some company-years are others, and no cause is known
_OTHER = BASE.replace("\nw AS (SELECT lpad(", "\nw0 AS (SELECT lpad(").replace(
    "\ngood AS (", "\nw AS (SELECT * REPLACE (CAST(CASE WHEN n % 10 = 3 AND year = 1996 THEN Net_Profit * 2 ELSE Net_Profit END AS DECIMAL(38,4)) AS Net_Profit, CASE WHEN n % 10 = 3 AND year = 1996 THEN Operating_Cash_Flow - 1000 ELSE Operating_Cash_Flow END AS Operating_Cash_Flow) FROM w0),\ngood AS ("
)
ORACLE_SQL["rescored"] = re.sub(r"attr0 AS \(.*?FROM paths\),", "attr0 AS (SELECT stock_code, year, indicator, source, {'cause': '其他', 'p': 1.0::DOUBLE} AS e FROM paths0),", _OTHER, flags=re.S) + f"{_SCORED} SELECT * FROM scored"
