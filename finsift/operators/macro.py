"""Dated facts about industries, as of the end of a fiscal year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsift.operators.reasoning import extract_facts, without_opinions
from finsift.sources import prompts
from finsift.sources.config import NO_FACTS

#: Facts of a context, and years after which a fact is too old for one.
MOST, YEARS = 20, 2


def fact_calls(searched: DataFrame) -> DataFrame:
    """(.., prompt_name, variables): the call that takes facts from the results of each
    search (search_query, search_results)."""
    values = {c: F.col(c) for c in ("search_query", "search_results")}
    return searched.select(*[c for c in searched.columns if c not in values], "search_query", F.lit("a0_macro_search").alias("prompt_name"), prompts.rendered("a0_macro_search", values).alias("variables"))


def facts_of_answers(answers: DataFrame) -> DataFrame:
    """(.., text) of answers (response), a row for each fact."""
    return answers.select(*[c for c in answers.columns if c != "response"], F.explode(extract_facts(F.col("response"))).alias("text"))


def sameness(text: Column) -> Column:
    """What near-equal facts have in common: their letters and numbers, in order, without
    dates, sources in brackets and signs."""
    bare = F.regexp_replace(F.lower(text), r"[（(\[【][^（()）\[\]【】]*[）)\]】]", "")
    bare = F.regexp_replace(bare, r"\d{4}年|\d{1,2}月|\d{1,2}日|\d{4}-\d{2}-\d{2}", "")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}.%]", "")


def as_of(facts: DataFrame, asked: DataFrame, most: int = MOST, years: int = YEARS) -> DataFrame:
    """(industry, year, macro_facts, n_facts): for each of ``asked`` (industry, year) the
    facts (industry, published, text) dated within the ``years`` years to its end, newest
    first, ``most`` at most, a line each.

    Of near-equal facts the newest counts.  Opinions, empty texts, facts without a date
    and the mark that nothing was found are left out; years without facts get that mark.
    A fact goes to the years it is in reach of by an equality, so no year is paired with
    all facts; only the ``most`` best of a year are gathered.
    """
    wanted = asked.select("industry", "year").distinct()
    good = without_opinions(facts.where("published is not null and industry is not null")).where(F.trim("text") != "")
    good = good.where(F.trim("text") != NO_FACTS).select("industry", "published", F.trim("text").alias("text"), sameness(F.col("text")).alias("same"))
    # what is said again on later days counts once, before it goes to its years
    reach = good.withColumn("year", F.explode(F.sequence(F.year("published"), F.year("published") + years - 1)))
    newest = reach.groupBy("industry", "year", "same").agg(F.max(F.struct("published", "text")).alias("f"))
    order = Window.partitionBy("industry", "year").orderBy(F.desc("f.published"), "f.text")
    best = newest.join(wanted, ["industry", "year"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    line = F.concat(F.date_format("f.published", "yyyy-MM-dd"), F.lit(" "), "f.text")
    listed = best.groupBy("industry", "year").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("a"))
    out = wanted.join(listed, ["industry", "year"], "left")
    text = F.array_join(F.transform("a", lambda x: x["line"]), "\n")
    return out.select("industry", "year", F.coalesce(text, F.lit(NO_FACTS)).alias("macro_facts"), F.coalesce(F.size("a"), F.lit(0)).alias("n_facts"))


def contexts(companies: DataFrame, tags: DataFrame, facts: DataFrame) -> DataFrame:
    """(stock_code, year, macro_facts, industry_tags): what the second path of questions
    may know, for ``companies`` (stock_code, industry, year)."""
    told = as_of(facts, companies)
    listed = tags.groupBy("stock_code").agg(F.array_join(F.array_sort(F.collect_set("tag")), "，").alias("industry_tags"))  # a tag for each dimension
    return companies.select("stock_code", "industry", "year").distinct().join(told, ["industry", "year"], "left").join(listed, "stock_code", "left").select("stock_code", "year", "macro_facts", F.concat_ws("，", "industry", "industry_tags").alias("industry_tags"))
