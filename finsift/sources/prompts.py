"""Prompt templates, compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own wording; names, variables and answer forms are the contract.
TEMPLATES = {
    "a0_macro_search": "Keep only dated, sourced facts about {{search_query}} from: {{search_results}}. Leave out opinions. Without any, answer 未找到客观数据.",
    "a1_tagging": 'Tag {{company_name}} ({{business_description}}) with one third-level industry and one listed option of each dimension:{% for tag in soft_tags %}\n{{tag.name}}: {{tag.options | join(", ")}}{% endfor %}\nAnswer JSON with hard_tag and soft_tags.',
    "b0_semantic_guide": "From these headers alone, give table_name, report_type, unit, columns and field_mapping as JSON: {{table_headers}}",
    "d1_lookup_notes": "Quote what explains {{indicator}} at {{actual_value}} ({{deviation}} MAD from peers), with pages, from: {{relevant_sections}}. Mark vague ones. Without any, answer 无直接解释.",
    "d1_hypothesis": "Up to 4 exclusive causes of {{indicator}} at {{deviation}}, from {{macro_facts}} and {{industry_tags}}, as a JSON array of hypothesis, reasoning and source.",
    "d2_probability": "Weigh causes of {{indicator}} ({{source}}): {{lookup_results}} against {{hypothesis_results}}. Answer JSON with probabilities, adding up to 1, and reasoning_summary.",
    "e2_report": "Bull and bear points, one sourced sentence of 50 characters each, for {{company_name}} {{report_year}}, score {{score}}: {{anomalies}}; peers: {{peer_comparison}}",
}

Scope = dict[str, Column]
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_FOR = re.compile(r"for\s+(\w+)\s+in\s+(.+)", re.S)
#: What may follow a value after a bar, with at most one text in quotes.
_FILTERS: dict[str, Callable[[Column, str | None], Column]] = {
    "join": lambda c, by: F.array_join(F.transform(c, lambda x: x.cast("string")), by or "", ""),
    "default": lambda c, other: F.coalesce(c.cast("string"), F.lit(other or "")),
    "upper": lambda c, _: F.upper(c),
    "lower": lambda c, _: F.lower(c),
    "trim": lambda c, _: F.trim(c),
    "length": lambda c, _: F.size(c),
}
_FILTER = re.compile(r"""^(\w+)\s*(?:\(\s*(?:"([^"]*)"|'([^']*)')?\s*\))?$""")


def _path(text: str) -> tuple[list[str], list[str]]:
    """The dotted name and the filters of ``name.field | filter("x")``."""
    path, *filters = (p.strip() for p in re.split(r"""\|(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", text))
    if not re.fullmatch(r"[^\W\d]\w*(\.\w+)*", path):
        raise ValueError(f"no name: {path!r}")
    return path.split("."), filters


def _value(text: str, scope: Scope) -> Column:
    """A value as a column; a name out of scope raises."""
    (name, *fields), filters = _path(text)
    out = scope[name]
    for f in fields:
        out = out[f]
    for f in filters:
        m = _FILTER.match(f)
        if not m or m[1] not in _FILTERS:
            raise ValueError(f"no filter: {f!r}")
        out = _FILTERS[m[1]](out, m[2] if m[2] is not None else m[3])
    return out


def _until(parts: list[str], at: int, *ends: str) -> tuple[list, int]:
    """Nodes of a block: texts, values, loops and conditions, up to one of ``ends``."""
    out: list = []
    while at < len(parts):
        p = parts[at]
        at += 1
        if p.startswith("{{"):
            out.append(("value", p[2:-2].strip()))
        elif p.startswith("{%"):
            word = p[2:-2].strip("- \n\t")
            if word in ends:
                return out, at - 1
            if m := _FOR.fullmatch(word):
                body, at = _until(parts, at, "endfor")
                out.append(("for", m[1], m[2].strip(), body))
                at += 1
            elif word.startswith("if "):
                yes, at = _until(parts, at, "else", "endif")
                no: list = []
                if parts[at][2:-2].strip("- \n\t") == "else":
                    no, at = _until(parts, at + 1, "endif")
                out.append(("if", word[3:].strip(), yes, no))
                at += 1
            else:
                raise ValueError(f"no tag: {word!r}")
        elif p:
            out.append(("text", p))
    if ends:
        raise ValueError(f"no {' or '.join(ends)}")
    return out, at


def _column(nodes: list, scope: Scope) -> Column:
    parts = [F.lit("")]
    for kind, *rest in nodes:
        if kind == "text":
            parts.append(F.lit(rest[0]))
        elif kind == "value":
            parts.append(F.coalesce(_value(rest[0], scope).cast("string"), F.lit("")))
        elif kind == "for":
            name, source, body = rest
            parts.append(F.coalesce(F.array_join(F.transform(_value(source, scope), lambda x: _column(body, scope | {name: x})), ""), F.lit("")))  # noqa: B023 - used at once
        else:
            test, yes, no = rest
            held = _value(test, scope).cast("string")
            parts.append(F.when(held.isNotNull() & ~held.isin("", "false", "0", "[]"), _column(yes, scope)).otherwise(_column(no, scope)))
    return F.concat(*parts)


def _names(nodes: list) -> list[str]:
    """Names that a template takes from outside."""
    out: list[str] = []
    for kind, *rest in nodes:
        if kind == "value":
            out += _path(rest[0])[0][:1]
        elif kind == "for":
            out += [*_path(rest[1])[0][:1], *(n for n in _names(rest[2]) if n != rest[0])]
        elif kind == "if":
            out += [*_path(rest[0])[0][:1], *_names(rest[1]), *_names(rest[2])]
    return list(dict.fromkeys(out))


def parsed(template: str) -> list:
    return _until(_TAG.split(template), 0)[0]


def variables(name: str) -> list[str]:
    """The columns that a template needs, in order of their first use."""
    return _names(parsed(TEMPLATES[name]))


def compiled(template: str, values: Scope) -> Column:
    """A template as one column expression: ``{{a.b | filter}}``, ``{% for x in xs %}`` to
    ``{% endfor %}`` over arrays, ``{% if a %}``, ``{% else %}``, ``{% endif %}``, nested as
    wanted.  Filters are join, default, upper, lower, trim and length.

    A null value or array gives no text; null, false, 0 and empty texts or arrays are
    not held for true; a variable without a column raises, as does a tag that isn't known.
    """
    nodes = parsed(template)
    missing = set(_names(nodes)) - set(values)
    if missing:
        raise KeyError(f"needs {sorted(missing)}")
    return _column(nodes, values)


def rendered(name: str, values: Scope) -> Column:
    """A named template with each variable's column put in; one that is missing raises."""
    try:
        return compiled(TEMPLATES[name], values)
    except KeyError as e:
        raise KeyError(f"{name} {e.args[0]}") from None
