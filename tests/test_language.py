"""Templates and answers: what goes to a language model and what comes back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from finsift.functions.schema import ANSWERS, violations
from finsift.sources import prompts, settings


def test_templates_with_loops_names_filters_and_conditions(spark):
    row = spark.createDataFrame(
        [("甲", [("资产结构", ["重", "轻"]), ("空", []), (None, None)], True, None)],
        "name string, tags array<struct<name:string,options:array<string>>>, ok boolean, gone string",
    )
    t = '{{ name }}:{% for t in tags %}\n- {{t.name | default("?")}} ({{ t.options | join(", ") }}){% for o in t.options %}<{{o}}|{{name}}>{% endfor %}{% endfor %}{% if gone %}no{% else %}{% if ok %}yes{% endif %}{% endif %}{{gone}}{{tags | length}}'
    got = row.select(prompts.compiled(t, {c: F.col(c) for c in row.columns}).alias("x")).first()["x"]
    assert got == "甲:\n- 资产结构 (重, 轻)<重|甲><轻|甲>\n- 空 ()\n- ? ()yes3"
    for bad in ("{% for x in tags %}", "{% while x %}", "{{ name | nothing }}", "{{ 1 + }}"):
        with pytest.raises(ValueError):
            prompts.compiled(bad, {"name": F.lit("x"), "tags": F.array()})
    with pytest.raises(KeyError):
        prompts.compiled("{% for x in xs %}{{x}}{{y}}{% endfor %}", {"xs": F.array(F.lit(1))})


#: Templates as a user's folder has them, one of each prompt.
USER = {
    "a0_macro_search": ["Extract facts only.", "Query: {{search_query}}\nResults: {{search_results}}"],
    "a1_tagging": ["You tag companies.", 'Name: {{company_name}}\nBusiness: {{business_description}}\n\n{% for tag in soft_tags %}\n- {{tag.name}}: one of {{tag.options | join(", ")}}\n{% endfor %}\n\n{"hard_tag": {"value": "..."}}'],
    "b0_semantic_guide": ['{"columns": {"x": "year"}}', "Headers: {{table_headers}}"],
    "d1_lookup_notes": ["Quote.", "{{indicator}} is {{actual_value}}, {{deviation}} MAD\n{{relevant_sections}}"],
    "d1_hypothesis": ["Guess.", "{{indicator}} {{deviation}}\n{{macro_facts}}\n{{industry_tags}}"],
    "d2_probability": ["Weigh.", "{{indicator}} ({{source}})\n{{lookup_results}}\n{{hypothesis_results}}"],
    "e2_report": ["Write.", "{{company_name}} {{report_year}} {{score}} {{anomalies}} {{peer_comparison}}"],
}


def test_a_folder_of_templates_renders_in_one_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prompts, "TEMPLATES", dict(prompts.TEMPLATES))
    (tmp_path / "prompts").mkdir()
    for name, (system, user) in USER.items():
        (tmp_path / "prompts" / f"{name}.json").write_text(json.dumps({"name": name, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}))
    settings.use(spark, str(tmp_path))
    names = {v for n in USER for v in prompts.variables(n)} - {"soft_tags"}
    df = spark.range(2).withColumns({n: F.concat(F.lit(f"<{n}>"), F.col("id").cast("string")) for n in names})
    df = df.withColumn("soft_tags", F.array(F.struct(F.lit("size").alias("name"), F.array(F.lit("big"), F.lit("small")).alias("options"))))
    rows = df.select(*[prompts.rendered(n, {c: F.col(c) for c in df.columns}).alias(n) for n in USER]).collect()
    assert len(rows) == 2 and rows[1]["a1_tagging"] == 'You tag companies.\n\nName: <company_name>1\nBusiness: <business_description>1\n\n\n- size: one of big, small\n\n\n{"hard_tag": {"value": "..."}}'
    assert all("{{" not in x and "{%" not in x for r in rows for x in r)
    assert rows[0]["d2_probability"] == "Weigh.\n\n<indicator>0 (<source>0)\n<lookup_results>0\n<hypothesis_results>0"


def plain_violations(x, schema, path="$"):
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool}
    kind, out = schema.get("type"), []
    number = isinstance(x, int | float) and not isinstance(x, bool)
    fits = {"integer": number and isinstance(x, int), "number": number}.get(kind, isinstance(x, kinds.get(kind, object)))
    if kind and not fits:
        return [(path, "type")]
    if "enum" in schema and x not in schema["enum"]:
        out.append((path, "enum"))
    for word, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b)):
        if word in schema and bad(x, schema[word]):
            out.append((path, word))
    for word, bad in (("maxLength", lambda a, b: len(a) > b), ("minLength", lambda a, b: len(a) < b), ("minItems", lambda a, b: len(a) < b), ("maxItems", lambda a, b: len(a) > b)):
        if word in schema and bad(x, schema[word]):
            out.append((path, word))
    if "items" in schema:
        out += [v for i, e in enumerate(x) for v in plain_violations(e, schema["items"], f"{path}[{i}]")]
    for name, part in schema.get("properties", {}).items():
        if name in x:
            out += plain_violations(x[name], part, f"{path}.{name}")
        elif name in schema.get("required", ()):
            out.append((f"{path}.{name}", "missing"))
    if "values" in schema:
        out += [v for k in sorted(x) for v in plain_violations(x[k], schema["values"], f"{path}.{k}")]
    return out


def test_violations_match_a_plain_check(spark):
    rng = random.Random(4)

    def value(schema, deep=0):
        if rng.random() < 0.15:
            return rng.choice([None, 3, "x", 2.5, True, [], {}, "y" * 60, -1])
        kind = schema.get("type")
        if kind == "object":
            out = {n: value(p, deep + 1) for n, p in schema.get("properties", {}).items() if rng.random() < 0.85}
            return out | {f"c{i}": value(schema["values"]) for i in range(rng.randrange(4)) if "values" in schema}
        if kind == "array":
            return [value(schema["items"], deep + 1) for _ in range(rng.randrange(6))]
        return {"string": "text", "integer": rng.randrange(-2, 9), "number": rng.choice([0.5, 1, 0, 1.5]), "boolean": True}.get(kind, "a")

    for schema in (*ANSWERS.values(), {"type": "array", "minItems": 2, "items": {"type": "string", "enum": ["text", "x"], "minLength": 2}}):
        values = [value(schema) for _ in range(60)]
        df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(-1, "{no"), (-2, None)], "i int, j string")
        got = {r["i"]: [tuple(v) for v in r["v"]] for r in df.select("i", violations(F.col("j"), schema).alias("v")).collect()}
        assert got.pop(-1) == got.pop(-2) == [("$", "json")]
        assert got == {i: plain_violations(v, schema) for i, v in enumerate(values)}
        assert any(got.values())
