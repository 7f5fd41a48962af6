"""Peers by industry and tags, and baselines from them and from a company's past."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PEERS, FEWEST = 5, 3


def tag_sets(tags: DataFrame) -> DataFrame:
    """(stock_code, industry, tags): sorted soft tags of each company."""
    return tags.groupBy("stock_code", "industry").agg(F.array_sort(F.collect_set("tag")).alias("tags"))  # a value for each dimension


def candidates(companies: DataFrame) -> DataFrame:
    """How many other companies share a company's industry, which locks its peers."""
    n = companies.groupBy("industry").agg((F.count("*") - 1).alias("n_candidates"))
    return companies.select("stock_code", "industry").join(n, "industry").select("stock_code", "n_candidates")


def similarity(sets: DataFrame) -> DataFrame:
    """Cosine of one-hot tags for the pairs of different tag sets of an industry.

    Tags are a closed list, so an industry has a bounded number of sets however
    many companies it has; companies are never paired.
    """
    own = sets.select("industry", "tags").distinct()
    a, b = own.withColumnRenamed("tags", "tags_a"), own.withColumnRenamed("tags", "tags_b")
    same = F.size(F.array_intersect("tags_a", "tags_b"))
    cosine = F.coalesce(F.try_divide(same.cast("double"), F.sqrt((F.size("tags_a") * F.size("tags_b")).cast("double"))), F.lit(0.0))
    return a.join(b, "industry").withColumn("similarity", F.round(cosine, 9))


def top_peers(sets: DataFrame, k: int = PEERS) -> DataFrame:
    """(stock_code, peer_code, similarity, rank): the k most similar others of the
    industry, ties by code.

    The first k + 1 codes of each tag set stand for it; of these the k + 1 best for
    each set of the industry hold the k best for every company of the set, itself
    left out.  Work is linear in companies.
    """
    first = Window.partitionBy("industry", "tags").orderBy("stock_code")
    heads = sets.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1).select("industry", F.col("tags").alias("tags_b"), F.col("stock_code").alias("peer_code"))
    best = Window.partitionBy("industry", "tags_a").orderBy(F.desc("similarity"), "peer_code")
    listed = similarity(sets).join(heads, ["industry", "tags_b"]).withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k + 1)
    listed = listed.groupBy("industry", F.col("tags_a").alias("tags")).agg(F.array_sort(F.collect_list(F.struct("__n", "peer_code", "similarity"))).alias("__list"))  # k + 1
    mine = sets.join(listed, ["industry", "tags"]).withColumn("__list", F.slice(F.filter("__list", lambda p: p["peer_code"] != F.col("stock_code")), 1, k))
    out = mine.select("stock_code", F.posexplode("__list").alias("__p", "peer"))
    return out.select("stock_code", "peer.peer_code", "peer.similarity", (F.col("__p") + 1).alias("rank"))


def peer_values(indicators: DataFrame, peers: DataFrame) -> DataFrame:
    """(stock_code, year, indicator, values, n_peers): the peers' values, k at most."""
    of = indicators.select(F.col("stock_code").alias("peer_code"), "year", "indicator", "value")
    got = peers.select("stock_code", "peer_code").join(of, "peer_code").where("value is not null")
    return got.groupBy("stock_code", "year", "indicator").agg(F.array_sort(F.collect_list("value")).alias("values")).withColumn("n_peers", F.size("values"))


def history(indicators: DataFrame, bad_years: DataFrame, years: int = 5) -> DataFrame:
    """Mean of a company's own indicator over the ``years`` years before, years in
    ``bad_years`` (stock_code, year) left out."""
    good = indicators.join(bad_years.select("stock_code", "year", F.lit(True).alias("__bad")), ["stock_code", "year"], "left")
    used = good.withColumn("__v", F.when(F.col("__bad").isNull(), F.col("value")))
    past = Window.partitionBy("stock_code", "indicator").orderBy("year").rangeBetween(-years, -1)
    return used.select("stock_code", "year", "indicator", "value", F.avg("__v").over(past).alias("historical_mean"), F.count("__v").over(past).alias("n_years"))
