"""Mixing sources to target weights (operator 1) by pivotal dependent rounding."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, partitions, shielded, staged

#: Documents that one leaf of the reduction tree rounds, and residuals that one
#: inner node combines.
LEAF, FAN_IN = 256, 64


def word_count(name: str = "text"):
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size, ..), a row for each source, with number and target.

    Sources in code point order, null last, are numbered and take ``weights`` in
    turn; they share ``share`` of all sizes.  A target stops at ``most`` times its
    source's size; what is over goes to the others by weight until none is above.
    Sources stay in Spark, however many: numbers come from the sizes of range
    partitions, and each step of resharing is one sum.
    """
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    ranged = staged(sizes.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = ranged.join(parts, "__part").withColumn("number", F.col("__before") + at - 1).drop("__part", "__before")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights)).cast("int"))
    out = staged(out.withColumn("__weight", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most))), "sources")
    total = out.agg(F.sum("source_size")).first()[0] or 0
    left, weighed = share * float(total), out.agg(F.sum("__weight")).first()[0] or 1.0
    while True:
        fair = F.lit(left) * F.col("__weight") / F.lit(weighed)
        over = F.col("__cap") < fair
        now = out.agg(F.sum(F.when(over, F.col("__cap"))).alias("cap"), F.sum(F.when(~over, F.col("__weight"))).alias("weight")).first()
        rest = share * float(total) - (now["cap"] or 0.0)
        if now["weight"] is None or (rest, now["weight"]) == (left, weighed):
            break
        left, weighed = rest, now["weight"]
    return out.withColumn("target", F.least("__cap", fair)).drop("__weight", "__cap")


def _uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on seed and salt alone."""
    x = seed.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def pivotal_pairs(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round units one pair after the other: the survivor of each meets the next unit.

    Words move between the two, in a direction drawn so that neither's expected
    count changes, until one is integral.  The words taken in all stay the same;
    one unit at most stays fractional.
    """
    held, out, draws = None, p.tolist(), u.tolist()
    for j, (r, b) in enumerate(zip(size.tolist(), p.tolist(), strict=True)):
        if not 0 < b < 1:
            continue
        if held is None:
            held, s = j, r
            continue
        a = out[held]
        up, down = min(s * (1 - a), r * b), min(s * a, r * (1 - b))
        if draws[j] * (up + down) < down:
            full, none = s * (1 - a) <= r * b, s * (1 - a) >= r * b
            out[held], out[j] = (1.0 if full else a + up / s), (0.0 if none else b - up / r)
        else:
            none, full = s * a <= r * (1 - b), s * a >= r * (1 - b)
            out[held], out[j] = (0.0 if none else a - down / s), (1.0 if full else b + down / r)
        if not 0 < out[held] < 1:
            held, s = (j, r) if 0 < out[j] < 1 else (None, 0)
    return np.array(out)


def _one(f):
    return lambda t: f(t)


def _rounded(t: pa.Table, by, salt: int, last: bool = False) -> pa.Table:
    """A node's units with their probabilities rounded, the largest unit first."""
    words, u = t["words"].to_numpy(), t["u"].to_numpy()
    order = np.lexsort((u, -words))
    p = by(words[order], t["p"].to_numpy()[order], _uniform(u[order], salt))
    if last:
        p = np.where((p > 0) & (p < 1), (_uniform(u[order], 99) < p).astype(float), p)
    t = t.take(pa.array(order))
    return t.set_column(t.column_names.index("p"), "p", pa.array(p))


def mix_plan(rows: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.0, most: float = 3.0, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, copies) for units of equal
    (doc_id, source, size), n rows each, from rows with those three columns.

    A unit's fractional copies are its source's target over its source's size.
    Leaves of LEAF units, dealt by a hash of the id, are rounded in parallel;
    each leaves one residual at most, and residuals meet in a tree of FAN_IN
    until one is left in a source, which is drawn by itself.  Only that last draw
    can move a source's words away from the target.
    """
    spark = rows.sparkSession
    units = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    units = staged(units, "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("units") / LEAF)).cast("long")
    known = targets(totals, weights, share, most).withColumn("leaves", leaves)
    known = known.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    table = staged(known.select(F.col("source").alias("__source"), "number", F.col("source_size").cast("long").alias("source_size"), "target", "ratio", "leaves"), "targets")
    most_leaves = table.agg(F.max("leaves")).first()[0] or 1
    whole = units.join(table, units["source"].eqNullSafe(table["__source"])).drop("__source")
    whole = whole.withColumn("words", F.col("size") * F.col("n")).withColumn("base", F.floor("ratio").cast("long"))
    whole = whole.withColumn("p", F.when(F.col("words") > 0, F.col("ratio") - F.col("base")).otherwise(0.0))
    whole = whole.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "source", "size")).withColumn("node", F.pmod(F.col("u"), F.col("leaves")))

    done = staged(whole.groupBy("number", "node").applyInArrow(lambda t: _rounded(t, pivotal_pairs, 1), whole.schema), "leaves")
    left = done.where("p > 0 and p < 1").select("number", "node", "doc_id", "size", "words", "p", "u")
    settled = None
    levels = int(np.ceil(np.log(max(2, most_leaves)) / np.log(FAN_IN)))
    for level in range(levels + 1):
        left = left.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        combine = partial(_rounded, by=pivotal_pairs, salt=2 + level, last=level == levels)
        level_out = staged(left.groupBy("number", "node").applyInArrow(_one(combine), left.schema), "level")
        now = level_out.where("p = 0 or p = 1").select("number", F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("p").alias("__p"))
        settled = now if settled is None else settled.unionByName(now)
        left = level_out.where("p > 0 and p < 1")
    out = done.join(settled.withColumnRenamed("number", "__number"), (done["number"] == F.col("__number")) & done["doc_id"].eqNullSafe(F.col("__id")) & (done["size"] == F.col("__size")), "left")
    return out.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("base") + F.coalesce("__p", "p")).cast("long").alias("copies"))


@shielded
def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.0, most: float = 3.0, seed: int = 1) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, 0 to
    ``most`` times, with the columns of ``docs``.

    Sources take ``weights`` in turn by code point, null last, and share
    ``share`` of all words; no target passes ``most`` times its source's words.
    The same seed gives the same mix, whatever the partitioning.

    A null text counts no words; a text without words is taken as its source's
    ratio rounded down, which moves no words; rows that are equal in doc_id,
    source and size (null ids too) are one unit and get the same copies; an
    empty table gives an empty one; other columns stay untouched.
    """
    sized = docs.withColumn("__size", word_count())
    plan = mix_plan(sized.select("doc_id", "source", F.col("__size").alias("size")), weights, share, most, seed)
    plan = plan.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__words"), F.col("copies").alias("__copies"))
    same = sized["doc_id"].eqNullSafe(plan["__id"]) & sized["source"].eqNullSafe(plan["__source"]) & (sized["__size"] == plan["__words"])
    taken = sized.join(plan, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*[docs[c] for c in docs.columns])
