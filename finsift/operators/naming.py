"""Names outside the vocabulary: candidates by an inverted index of character pairs,
ranked by edit distance, and learned as aliases that later runs join first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsift.sources import config
from finsift.sources.work import there

#: Least confidence of a suggestion.  Two thirds is also the least at which no name can
#: be missed: that many edits leave one pair of characters at least.
LEAST = 2 / 3
ALIAS = "raw_name string, standard_name string, statement string, priority int, known string, confidence double"


def cleaned(name: Column) -> Column:
    """A name without blanks, numbering, leading "less" or "of which", and notes in brackets."""
    bare = F.regexp_replace(name, "[ 　\t]", "")
    bare = F.regexp_replace(bare, "^(?:[一二三四五六七八九十]+、|[（(][一二三四五六七八九十]+[）)]|[0-9]+[、.])", "")
    bare = F.regexp_replace(bare, "^(?:其中|减|加)[:：]", "")
    return F.regexp_replace(bare, "[（(][^（()）]*[）)]$", "")


def pairs(name: Column) -> Column:
    """Pairs of neighbouring characters, both ends included."""
    closed = F.concat(F.lit("^"), name, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(closed) - 1), lambda i: F.substring(closed, i, F.lit(2))))


def _means(name: str, known: str) -> Column:
    """Whether no word tells a name from a known one: it holds none of QUALIFIERS that the
    known name lacks, and lacks none of MARKERS that the known name holds."""
    has = lambda c, q: F.contains(F.col(c), F.lit(q))
    out = F.lit(True)
    for q in config.QUALIFIERS:
        out = out & (~has(name, q) | has(known, q))
    for q in config.MARKERS:
        out = out & (~has(known, q) | has(name, q))
    return out


def suggestions(names: DataFrame, least: float = LEAST) -> DataFrame:
    """(raw_name, standard_name, statement, priority, known, confidence) of names
    (``raw_name``; repeated rows count once) that are near one of the vocabulary.

    Confidence is 1 less the edits between the cleaned name and the known one, for each
    letter of the longer.  A word that changes the meaning (``config.QUALIFIERS``) keeps
    names apart however alike they are.  The surest known name counts, then that of best priority;
    where names of two standard fields are equally sure there is no suggestion.  Null and
    empty names have none.

    Names are made distinct first, so work follows the number of different names; each
    meets only the known names that share a pair of characters.
    """
    raw = names.select("raw_name").where("raw_name is not null").distinct().withColumn("name", cleaned(F.col("raw_name"))).where("name <> ''")
    known = config.fields(names.sparkSession).withColumnRenamed("raw_name", "known")
    index = known.withColumn("pair", F.explode(pairs(F.col("known"))))
    met = raw.withColumn("pair", F.explode(pairs(F.col("name")))).join(index, "pair").drop("pair").distinct()
    sure = 1 - F.levenshtein("name", "known") / F.greatest(F.char_length("name"), F.char_length("known"))
    near = met.withColumn("confidence", F.round(sure, 9)).where((F.col("confidence") >= round(least, 9)) & _means("name", "known"))
    each = Window.partitionBy("raw_name")
    top = near.withColumn("__top", F.max("confidence").over(each)).where("confidence = __top")
    one = top.withColumn("__fields", F.size(F.collect_set("standard_name").over(each))).where("__fields = 1")
    best = one.groupBy("raw_name").agg(F.min(F.struct("priority", "known", "standard_name", "statement", "confidence")).alias("b"))
    return best.select("raw_name", "b.standard_name", "b.statement", "b.priority", "b.known", "b.confidence")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """The aliases learned so far; none where the folder isn't there."""
    return spark.read.schema(ALIAS).parquet(path) if there(spark, path) else spark.createDataFrame([], ALIAS)


def learn(names: DataFrame, path: str, least: float = 0.8) -> DataFrame:
    """Add the sure suggestions for names without one to the alias table at ``path``, and
    give the whole table.  Only names new to it are looked for."""
    spark = names.sparkSession
    new = names.select("raw_name").join(aliases(spark, path), "raw_name", "left_anti")
    suggestions(new, least).select(*[c.split()[0] for c in ALIAS.split(", ")]).write.mode("append").parquet(path)
    return aliases(spark, path)
