"""Sharding (operator 2): contiguous shards of nearly equal bytes, from global
prefix sums of sizes.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shielded, staged, without

OUT = ("size", "text_crc32", "shard", "slot")


@shielded
def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot.

    Rows are ordered by id, then size, checksum and the hash of the whole row;
    a row's size is the UTF-8 bytes of its text plus 1.  The order is cut where
    the running size passes k/n of the total, each row going to the side that
    holds its middle, so shards are contiguous and their sizes differ by about
    one row's size at most.  ``slot`` numbers a shard's rows from 0 without gaps.

    The running size comes from the totals of range partitions plus a running
    sum inside each, so no task ever sees more than one range.

    A null text counts 1 byte and has a null checksum; null ids come first;
    repeated rows and ties each get a slot of their own; an empty table gives an
    empty one; with fewer rows than shards some shards stay empty.  Columns of
    ``docs`` that bear an output's name are replaced; with ``keep_text`` false the
    result leaves the text out, and no text is moved.
    """
    spark = docs.sparkSession
    base = without(docs, *OUT).withColumn("size", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1)
    base = base.withColumn("text_crc32", F.crc32(F.col(text_col).cast("binary")))
    order = [F.col(id_col), F.col("size"), F.col("text_crc32"), F.col("__tie"), F.col("__row")]
    plain = [c for c, t in base.dtypes if "map<" not in t and "variant" not in t]
    # rows that are equal in all this are told apart by their place, so that however
    # many there are they need not share a range; which comes first makes no difference
    base = base.withColumn("__tie", F.xxhash64(*plain)).withColumn("__row", F.monotonically_increasing_id())
    base = base if keep_text else base.drop(text_col)
    # the ranges are written down, since a second evaluation could draw other bounds
    ranged = staged(base.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id()), "ranges")
    rows = _placed(ranged, n_shards, order)
    # a shard is a run of the order, so its rows before are known from its first one
    first = _placed(ranged.select("__part", *order), n_shards, order).groupBy("shard").agg(F.min("__rank").alias("__first"))
    out = rows.join(F.broadcast(first), "shard")  # n_shards rows
    out = out.withColumn("slot", F.col("__rank") - F.col("__first"))
    return out.select(*[c for c in base.columns if c not in ("__tie", "__row")], "shard", "slot")


def _placed(ranged: DataFrame, n_shards: int, order: list) -> DataFrame:
    """``ranged`` with shard and the global rank of each row; one row for each
    range partition is all that is summed globally."""
    whole = Window.orderBy("__part")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    parts = parts.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    rows = ranged.withColumn("__end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__at", F.row_number().over(inside))
    middle = (2 * (F.col("__bytes_before") + F.col("__end")) - F.col("size")) * n_shards
    return rows.join(parts, "__part").select(
        *[ranged[c] for c in ranged.columns],
        F.least(F.lit(n_shards - 1), F.floor(middle / (2 * F.col("__total")))).cast("int").alias("shard"),
        (F.col("__rows_before") + F.col("__at")).alias("__rank"),
    )
