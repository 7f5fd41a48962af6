"""Causes of anomalies: retrieval, rules, and a provider for what needs a language
model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsift.functions.columns import fenced
from finsift.operators.gateway import ANSWER, Provider, ask, logged, well_formed
from finsift.sources import prompts
from finsift.sources.config import NO_EXPLANATION, NO_FACTS, OPINIONS
from finsift.sources.work import staged, there

EXPLANATION = "summary string, source_text string, page_number int, is_vague boolean"
HYPOTHESES = "array<struct<hypothesis:string,reasoning:string,source:string>>"
#: Phrases that explain nothing.
VAGUE = ("综合影响", "多种因素", "市场环境", "诸多因素", "正常波动")
OTHER, MOST_OTHER, MOST_CAUSES = "其他", 0.2, 4
#: What a log row counts.
USED = ("calls", "errors", "tries", "prompt_tokens", "answer_tokens")


def without_opinions(facts: DataFrame, text: str = "text") -> DataFrame:
    return facts.where(~F.coalesce(F.col(text).rlike("|".join(OPINIONS)), F.lit(False)))


def no_sentinel(text: Column, sentinel: str) -> Column:
    """The text, or null where it only says that nothing was found."""
    return F.when(F.trim(text) != sentinel, text)


def tag_violations(tags: DataFrame, options: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tags, other spellings replaced, whose value isn't one of the options."""
    named = tags.join(F.broadcast(aliases.withColumnRenamed("value", "__v")), tags["value"] == F.col("alias"), "left")  # the closed list
    named = named.withColumn("value", F.coalesce("__v", "value")).drop("__v", "alias")
    return named.join(F.broadcast(options), ["dimension", "value"], "left_anti")


def relevant_sections(sections: DataFrame, keywords: list[tuple[str, str]]) -> DataFrame:
    """(key, indicator, hits): sections that contain a keyword of an indicator, with
    the number of its keywords.  ``keywords`` are (keyword, indicator), a closed
    vocabulary; texts are read once, where they are, for Chinese has no words to
    join on."""
    if not keywords:
        return sections.select("key", F.lit(None).cast("string").alias("indicator"), F.lit(0).cast("long").alias("hits")).where("false")
    low = sections.withColumn("__t", F.lower("text"))
    found = F.array(*[F.struct(F.lit(i).alias("indicator"), F.contains(F.col("__t"), F.lit(k.lower())).alias("has")) for k, i in dict.fromkeys(keywords)])
    hits = low.select("key", F.explode(F.filter(found, lambda h: h["has"])).alias("h"))
    return hits.groupBy("key", F.col("h.indicator").alias("indicator")).agg(F.count("*").alias("hits"))


def evidence(anomalies: DataFrame, sections: DataFrame, keywords: list[tuple[str, str]]) -> DataFrame:
    """(stock_code, year, indicator, summary, source_text, page_number, is_vague): for
    each anomaly (stock_code, year, indicator) the sentence of its own report
    (``sections``: stock_code, year, title, content, page_number) that names one of
    its keywords, of the first page that has one.  A sentence of commonplaces is vague."""
    pairs = dict.fromkeys(keywords)
    if not pairs:
        pairs = {("\0", "\0"): None}
    said = sections.select("stock_code", "year", "page_number", F.posexplode(F.split("content", r"(?<=[。！？!?])|\n")).alias("pos", "sentence"))
    named = F.array(*[F.struct(F.lit(i).alias("indicator"), F.contains(F.lower("sentence"), F.lit(k.lower())).alias("has")) for k, i in pairs])
    hits = said.select("stock_code", "year", "page_number", "pos", F.trim("sentence").alias("sentence"), F.explode(F.array_distinct(F.transform(F.filter(named, lambda h: h["has"]), lambda h: h["indicator"]))).alias("indicator"))
    first = hits.join(anomalies.select("stock_code", "year", "indicator").distinct(), ["stock_code", "year", "indicator"]).groupBy("stock_code", "year", "indicator").agg(F.min(F.struct("page_number", "pos", "sentence")).alias("f"))
    out = first.select("stock_code", "year", "indicator", F.substring("f.sentence", 1, 50).alias("summary"), F.col("f.sentence").alias("source_text"), "f.page_number")
    return out.withColumn("is_vague", F.col("source_text").rlike("|".join(VAGUE)))


def lookup_calls(anomalies: DataFrame, found: DataFrame) -> DataFrame:
    """(stock_code, year, indicator, source, prompt_name, variables): a call of the
    first path for each anomaly, with what its report says."""
    key = ["stock_code", "year", "indicator"]
    values = {"indicator": F.col("indicator"), "actual_value": F.col("actual"), "deviation": F.col("multiple"), "relevant_sections": F.concat_ws("", F.lit("["), F.col("page_number").cast("string"), F.lit("] "), F.col("source_text"))}
    return anomalies.join(found, key, "left").select(*key, "source", F.lit("d1_lookup_notes").alias("prompt_name"), prompts.rendered("d1_lookup_notes", values).alias("variables"))


def hypothesis_calls(anomalies: DataFrame, context: DataFrame) -> DataFrame:
    """The same for the second path, from ``context`` (stock_code, year if it has one,
    macro_facts, industry_tags) alone."""
    values = {"indicator": F.col("indicator"), "deviation": F.col("multiple"), "macro_facts": F.col("macro_facts"), "industry_tags": F.col("industry_tags")}
    return anomalies.join(context, [c for c in ("stock_code", "year") if c in context.columns], "left").select("stock_code", "year", "indicator", "source", F.lit("d1_hypothesis").alias("prompt_name"), prompts.rendered("d1_hypothesis", values).alias("variables"))


def probability_calls(paths: DataFrame) -> DataFrame:
    """The calls that weigh both paths (lookup, hypothesis: answers as text)."""
    values = {"indicator": F.col("indicator"), "source": F.col("source"), "lookup_results": F.col("lookup"), "hypothesis_results": F.col("hypothesis")}
    return paths.select("stock_code", "year", "indicator", "source", F.lit("d2_probability").alias("prompt_name"), prompts.rendered("d2_probability", values).alias("variables"))


def read_lookup(raw: Column) -> Column:
    """An answer of the first path as a struct; null where it found nothing."""
    return F.when(~F.coalesce(F.contains(raw, F.lit(NO_EXPLANATION)), F.lit(False)), parsed_response(raw, EXPLANATION))


def read_hypotheses(raw: Column) -> Column:
    """An answer of the second path: MOST_CAUSES hypotheses at most."""
    return F.slice(F.filter(parsed_response(raw, HYPOTHESES), lambda h: h["hypothesis"].isNotNull()), 1, MOST_CAUSES)


def read_probabilities(raw: Column) -> Column:
    """An answer of the weighing as a map, null unless it is valid."""
    p = parsed_response(raw, "probabilities map<string,double>, reasoning_summary string")["probabilities"]
    return F.when(valid_probabilities(p), p)


def dual_path(anomalies: DataFrame, found: DataFrame, context: DataFrame, provider: Callable[[], Provider], cache: str, **how) -> DataFrame:
    """(stock_code, year, indicator, source, lookup, hypotheses, probabilities): both
    paths for each of ``anomalies`` (.., source, actual, multiple), asked side by
    side in one pass, then weighed; what the weighing doesn't answer validly goes by
    :func:`rule_probabilities`.  Answers are kept in ``cache``."""
    key = ["stock_code", "year", "indicator", "source"]
    calls = lookup_calls(anomalies, found).unionByName(hypothesis_calls(anomalies, context))
    # written, since the engine takes two readings of a folder for one, however it has grown
    got = staged(answered(calls, provider, cache, **how), "answers")
    both = got.groupBy(*key).agg(*[F.max(F.when(F.col("prompt_name") == p, F.col("response"))).alias(n) for p, n in (("d1_lookup_notes", "lookup"), ("d1_hypothesis", "hypothesis"))])
    weighed = answered(probability_calls(both), provider, cache, **how).select(*key, read_probabilities(F.col("response")).alias("weighed"))
    both = both.join(weighed, key).withColumn("lookup", read_lookup(F.col("lookup"))).withColumn("hypotheses", read_hypotheses(F.col("hypothesis")))
    named = both.withColumn("path1", F.col("lookup.summary")).withColumn("path2", F.get("hypotheses", 0)["hypothesis"])
    named = named.withColumn("is_vague", F.coalesce("lookup.is_vague", F.lit(False))).withColumn("conflict", F.coalesce(F.col("path1") != F.col("path2"), F.lit(False)))
    ruled = rule_probabilities(named)
    return ruled.select(*key, "lookup", "hypotheses", F.coalesce("weighed", "probabilities").alias("probabilities"))


def extract_facts(raw: Column) -> Column:
    """The facts of an answer: its JSON array of texts, or else its lines without
    bullets and numbers; opinions and the mark that nothing was found are left out."""
    text = fenced(raw)
    listed = F.from_json(text, "array<string>")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.、)])\s*", "")))
    return F.filter(F.coalesce(listed, lines), lambda x: (x != "") & ~F.contains(x, F.lit(NO_FACTS)) & ~x.rlike("|".join(OPINIONS)))


def rule_probabilities(paths: DataFrame) -> DataFrame:
    """(..., probabilities) by rule, from path1 (an explanation in the report, or
    null), is_vague, path2 (a hypothesis, or null), conflict and source.

    A clear explanation without conflict takes 0.7; without an explanation the
    hypothesis leads, and explains an internal check whole if it is the nature of
    the industry; a vague or contested explanation shares with the hypothesis.
    """
    p1, p2 = no_sentinel(F.col("path1"), NO_EXPLANATION), F.col("path2")
    clear = p1.isNotNull() & ~F.col("is_vague") & ~F.col("conflict")
    m = lambda *pairs: F.create_map(*[F.lit(x) if isinstance(x, str | float) else x for pair in pairs for x in pair])
    rule = F.when(p1.isNull() & p2.isNull(), m((OTHER, 1.0)))
    rule = rule.when(p1.isNull() & (F.col("source") == "B+") & (p2 == "行业特性"), m((p2, 1.0)))
    rule = rule.when(p1.isNull(), m((p2, 0.8), (OTHER, 0.2)))
    rule = rule.when(p2.isNull() | (p1 == p2), m((p1, 0.8), (OTHER, 0.2)))
    rule = rule.when(clear, m((p1, 0.7), (p2, 0.1), (OTHER, 0.2)))
    return paths.withColumn("probabilities", rule.otherwise(m((p1, 0.4), (p2, 0.4), (OTHER, 0.2))))


def valid_probabilities(p: Column) -> Column:
    """Whether probabilities add up to 1, "other" takes 0.2 at most (unless alone) and
    causes are four at most."""
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda a, x: a + x)
    other = F.coalesce(F.try_element_at(p, F.lit(OTHER)), F.lit(0.0))
    return (F.abs(total - 1) < 1e-9) & ((other <= MOST_OTHER + 1e-9) | (F.size(p) == 1)) & (F.size(F.filter(F.map_keys(p), lambda k: k != OTHER)) <= MOST_CAUSES)


def attribution_line(indicator: Column, p: Column) -> Column:
    """``indicator => 归因：A(60%)，B(30%)``, the likeliest first, ties by name."""
    parts = F.transform(F.array_sort(F.transform(F.map_entries(p), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), lambda e: F.concat(e["k"], F.lit("("), F.round(-e["v"] * 100).cast("int").cast("string"), F.lit("%)")))
    return F.concat(indicator, F.lit(" => 归因："), F.array_join(parts, "，"))


def parsed_response(raw: Column, schema: str) -> Column:
    """A response's JSON by an explicit schema, fenced or not; null fields where it
    is malformed."""
    return F.from_json(fenced(raw), schema)


def cache_key(prompt: Column, variables: Column) -> Column:
    return F.sha2(F.concat(prompt, F.lit("\n"), variables), 256)


def cache_misses(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """Calls (prompt_name, variables) that the cache (cache_key) doesn't answer, once each."""
    keyed = calls.withColumn("cache_key", cache_key(F.col("prompt_name"), F.col("variables")))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def answered(calls: DataFrame, provider: Callable[[], Provider], cache: str, only_cache: bool = False, strict: bool = False, **how) -> DataFrame:
    """``calls`` (.., prompt_name, variables) with their response, from the Parquet
    folder ``cache``; what it lacks is asked (:func:`gateway.ask`) and added first, unless
    ``only_cache``.  Only answers are kept, with ``strict`` only such as have their prompt's
    form, so others are asked again next time.  Each time a row of what was used is added
    to the folder ``cache`` with ``_log`` to its name."""
    spark = calls.sparkSession
    schema = f"{ANSWER}, prompt_name string"
    keyed = calls.withColumn("cache_key", cache_key(F.col("prompt_name"), F.col("variables")))

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(cache)

    if not there(spark, cache):
        spark.createDataFrame([], schema).write.parquet(cache)
    if not only_cache:
        # written first, for a call that is computed twice is asked twice
        missing = staged(cache_misses(calls, stored()).select("cache_key", "prompt_name", "variables"), "missing")
        asked = staged(ask(missing, provider, **how), "asked")
        new = asked.join(missing.select("cache_key", "prompt_name"), "cache_key").select(*[c.split()[0] for c in schema.split(", ")])
        good = well_formed(F.col("prompt_name"), F.col("response")) if strict else F.lit(True)
        new.where(F.col("error").isNull() & good).write.mode("append").parquet(cache)
        used = logged(asked, lambda df: df.write.format("noop").mode("overwrite").save())
        spark.createDataFrame([tuple(used[c] for c in USED)], ", ".join(f"{c} long" for c in USED)).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{cache}_log")
    # a run that was cut short may have added an answer twice
    known = stored().groupBy("cache_key").agg(F.min("response").alias("response"))
    return keyed.join(known, "cache_key", "left").drop("cache_key")
