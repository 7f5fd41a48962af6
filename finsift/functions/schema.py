"""Checks of JSON answers against a schema, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FAULTS = "array<struct<path:string,fault:string>>"
#: Variant types of each JSON type.
_TYPES = {
    "object": r"^(OBJECT|STRUCT)",
    "array": r"^ARRAY",
    "string": r"^STRING",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": r"^BOOLEAN",
}


def _fault(path: Column, fault: str) -> Column:
    return F.struct(path.alias("path"), F.lit(fault).alias("fault"))


def _when(bad: Column, path: Column, fault: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_fault(path, fault))).otherwise(F.array().cast(_FAULTS))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _checked(v: Column, schema: dict, path: Column) -> Column:
    """Violations of a value that is there (a variant, JSON null included)."""
    kind = schema.get("type")
    faults = []
    if "enum" in schema:
        faults.append(_when(~F.coalesce(_get(v, "$", "string").isin(*schema["enum"]), F.lit(False)), path, "enum"))
    if kind in ("integer", "number"):
        n = _get(v, "$", "double")
        if "minimum" in schema:
            faults.append(_when(n < schema["minimum"], path, "minimum"))
        if "maximum" in schema:
            faults.append(_when(n > schema["maximum"], path, "maximum"))
    if kind == "string":
        s = _get(v, "$", "string")
        if "maxLength" in schema:
            faults.append(_when(F.char_length(s) > schema["maxLength"], path, "maxLength"))
        if "minLength" in schema:
            faults.append(_when(F.char_length(s) < schema["minLength"], path, "minLength"))
        if "pattern" in schema:
            faults.append(_when(~s.rlike(schema["pattern"]), path, "pattern"))
    if kind == "array":
        items = _get(v, "$", "array<variant>")
        if "minItems" in schema:
            faults.append(_when(F.size(items) < schema["minItems"], path, "minItems"))
        if "maxItems" in schema:
            faults.append(_when(F.size(items) > schema["maxItems"], path, "maxItems"))
        if "items" in schema:
            one = lambda x, i: _checked(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
            faults.append(F.flatten(F.transform(items, one)))
    if kind == "object":
        for name, part in schema.get("properties", {}).items():
            at = F.concat(path, F.lit(f".{name}"))
            x = F.try_variant_get(v, f"$['{name}']", "variant")
            absent = _when(F.lit(True), at, "missing") if name in schema.get("required", ()) else F.array().cast(_FAULTS)
            faults.append(F.when(x.isNull(), absent).otherwise(_checked(x, part, at)))
        if "values" in schema:  # of an object with any names
            entries = F.map_entries(_get(v, "$", "map<string,variant>"))
            one = lambda e: _checked(e["value"], schema["values"], F.concat(path, F.lit("."), e["key"]))
            faults.append(F.flatten(F.transform(F.array_sort(F.transform(entries, lambda e: e["key"])), lambda k: F.flatten(F.transform(F.filter(entries, lambda e: e["key"] == k), one)))))
    inner = F.concat(*faults) if len(faults) > 1 else faults[0] if faults else F.array().cast(_FAULTS)
    inner = F.coalesce(inner, F.array().cast(_FAULTS))
    if kind is None:
        return inner
    fits = F.schema_of_variant(v).rlike(_TYPES[kind])
    return F.when(fits, inner).otherwise(F.array(_fault(path, "type")))


def violations(json: Column, schema: dict) -> Column:
    """Every violation of a schema as an array of (path, fault), in the schema's order; an
    empty one where the JSON fits.

    ``schema`` is a JSON schema of type, required, properties, items, enum, minimum,
    maximum, minLength, maxLength, pattern, minItems and maxItems, and ``values`` for
    objects with any names.  Faults are called by the word that is violated; a required
    field that isn't there is "missing", and text that is no JSON (or null) is "json".
    A value of a wrong type is that fault alone.  JSON null is of no type.
    """
    v = F.try_parse_json(json)
    return F.when(v.isNull(), F.array(_fault(F.lit("$"), "json"))).otherwise(_checked(v, schema, F.lit("$")))


#: Forms of the answers to the prompts.
ANSWERS = {
    "a1_tagging": {
        "type": "object",
        "required": ["hard_tag", "soft_tags"],
        "properties": {
            "hard_tag": {"type": "object", "required": ["value"], "properties": {"system": {"type": "string"}, "value": {"type": "string", "minLength": 1}}},
            "soft_tags": {"type": "array", "items": {"type": "object", "required": ["dimension", "value"], "properties": {"dimension": {"type": "string"}, "value": {"type": "string"}}}},
        },
    },
    "d1_lookup_notes": {
        "type": "object",
        "required": ["summary"],
        "properties": {"summary": {"type": "string", "minLength": 1}, "source_text": {"type": "string"}, "page_number": {"type": "integer", "minimum": 1}, "is_vague": {"type": "boolean"}},
    },
    "d1_hypothesis": {
        "type": "array",
        "maxItems": 4,
        "items": {"type": "object", "required": ["hypothesis"], "properties": {"hypothesis": {"type": "string", "minLength": 1}, "reasoning": {"type": "string"}, "source": {"type": "string"}}},
    },
    "d2_probability": {
        "type": "object",
        "required": ["probabilities"],
        "properties": {"probabilities": {"type": "object", "values": {"type": "number", "minimum": 0, "maximum": 1}}, "reasoning_summary": {"type": "string"}},
    },
    "e2_report": {
        "type": "object",
        "required": ["bull", "bear"],
        "properties": {side: {"type": "array", "items": {"type": "string", "minLength": 1, "maxLength": 50}} for side in ("bull", "bear")},
    },
}
