"""Line deduplication (operator 5): deletion neighbourhoods of lines, joined by
hash, verified by edit distance.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, staged, without

#: Shortest line that is compared with lines one edit away, by default; shorter ones,
#: and those without a word, only have equal copies.
SHORTEST = 10


def _lines(docs: DataFrame) -> DataFrame:
    """(at, x, y, line): a row for each line that has a word; ``at`` orders rows by
    document and place, x and y name the line's text."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t", "pos")
    # the text is hashed and left behind before its lines become rows
    whole = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.split("text", "\n", -1).alias("lines"))
    rows = whole.select("doc_id", "t", F.posexplode("lines").alias("pos", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(place.alias("at"), F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y"), "line")


def _edge(i: Column, length: Column, m: Column) -> Column:
    return F.floor(i * length / m).cast("int")


def _blocks(line: Column, n: Column, length: Column, m: Column, shortest: int) -> Column:
    """For a line of n characters as a neighbour of lines of ``length``: for each of m
    blocks, a hash of all before the block and all after it."""

    def one(i: Column) -> Column:
        begin, end = _edge(i, length, m), _edge(i + 1, length, m)
        key = F.xxhash64(length, m, i, F.substring(line, F.lit(1), begin), F.substring(line, n - length + end + 1, length - end))
        return F.struct(key.alias("key"), i.alias("i"), length.alias("length"))

    return F.when(length >= shortest, F.transform(F.sequence(F.lit(0), m - 1), one)).otherwise(F.array().cast("array<struct<key:bigint,i:int,length:int>>"))


def _both(line: Column, m, shortest: int) -> Column:
    """Blocks of a line as one of its own length and as one character longer than
    another: two lines within one edit agree outside one block of the shorter's."""
    n = F.char_length(line)
    return F.concat(_blocks(line, n, n, m(n), shortest), _blocks(line, n, n - 1, m(n - 1), shortest))


def _halves(lines: DataFrame, shortest: int) -> DataFrame:
    """(x, y, key): what :func:`_both` gives for two blocks, in plain expressions."""
    sized = lines.withColumn("n", F.char_length("line")).where(F.col("n") >= shortest)
    line, n = F.col("line"), F.col("n")

    def of(length: Column) -> list[Column]:
        half = F.floor(length / 2).cast("int")
        return [F.xxhash64(length, F.lit(0), F.substring(line, n - length + half + 1, length - half)), F.xxhash64(length, F.lit(1), F.substring(line, F.lit(1), half))]

    own, less = of(n), of(n - 1)
    keys = F.array(*own, *[F.when(n > shortest, k) for k in less])
    return sized.select("x", "y", F.explode(keys).alias("key")).where("key is not null")


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, x, ...) whose key two different lines have.  The
    keys are written down, for making them costs more than reading them twice."""
    keys = staged(keys, "keys")
    found = keys.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("key")
    return keys.join(found, "key")


def near_lines(lines: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(x, y) of the lines that an earlier line within one edit supersedes, from
    ``lines`` (at, x, y, line).

    Lines are narrowed in two steps to blocks: halves, then as many blocks as the
    square root of the length, agreeing in all but one.  Within such a block a
    line emits its deletion variants, hashed.  Equal variants with the same place
    left out are lines one letter apart, all within one edit of each other; a
    variant equal to a whole line is one letter longer.  So a group needs to be
    compared with its earliest line only, by edit distance, and no pairs are made
    within it.
    """
    line = F.col("line")
    some = _shared(_halves(lines, shortest)).select("x", "y").distinct()
    texts = lines.join(some, ["x", "y"]).groupBy("x", "y").agg(F.min("at").alias("first"), F.first("line").alias("line"))
    texts = staged(texts, "texts")
    root = lambda n: F.greatest(F.lit(2), F.ceil(F.sqrt(n)).cast("int"))
    blocks = texts.select("x", "y", F.explode(_both(line, root, shortest)).alias("b")).select("x", "y", "b.*")
    blocks = staged(_shared(blocks).select("x", "y", "i", "length").distinct(), "blocks")
    held = texts.join(blocks, ["x", "y"]).withColumn("n", F.char_length("line"))
    own = F.col("n") == F.col("length")
    begin, end = _edge(F.col("i"), F.col("length"), root(F.col("length"))), _edge(F.col("i") + 1, F.col("length"), root(F.col("length")))

    def variant(p: Column) -> Column:
        cut = F.concat(F.substring(line, F.lit(1), p), F.substring(line, p + 2, F.col("n")))
        return F.struct(F.xxhash64(cut).alias("a"), F.xxhash64(F.lit(1), cut).alias("b"), F.when(own, p).otherwise(-1).alias("p"))

    # an own block leaves out each of its places; a longer line also the one after
    places = F.sequence(begin, F.when(own, F.greatest(begin, end - 1)).otherwise(end))
    variants = held.select("x", "y", "first", F.explode(F.transform(places, variant)).alias("v")).select("x", "y", "first", "v.*", F.lit(False).alias("whole"))
    wholes = held.where(own).select("x", "y", "first", F.col("x").alias("a"), F.col("y").alias("b"), F.lit(-1).alias("p"), F.lit(True).alias("whole"))
    every = staged(variants.union(wholes).distinct(), "variants")
    me = F.struct("first", "x", "y")
    groups = every.groupBy("a", "b", "p").agg(F.min(F.when(~F.col("whole"), me)).alias("cut"), F.min(F.when(F.col("whole"), me)).alias("entire"), F.count("*").alias("n")).where("n > 1")
    # letters changed: the earliest of the group; a letter more: the whole line, or its earliest longer one
    pairs = every.join(groups, ["a", "b", "p"])
    head = F.when(F.col("p") >= 0, F.col("cut")).when(F.col("whole"), F.col("cut")).otherwise(F.col("entire"))
    pairs = pairs.select("x", "y", "first", head.alias("h")).where("h.first < first").select("x", "y", F.col("h.x").alias("hx"), F.col("h.y").alias("hy")).distinct()
    heads = texts.select(F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("line").alias("other"))
    checked = pairs.join(texts.select("x", "y", "line"), ["x", "y"]).join(heads, ["hx", "hy"])
    return checked.where(F.levenshtein("line", "other", 1) >= 0).select("x", "y").distinct()


def duplicate_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, t, removed) of the documents that lose lines, t being a hash of the
    text and ``removed`` the sorted numbers, from 0, of the lines."""
    lines = _lines(docs.select("doc_id", "text"))
    late = staged(near_lines(lines, shortest).withColumn("late", F.lit(True)), "late")
    first = lines.groupBy("x", "y").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    gone = first.join(late, ["x", "y"], "left").where("n > 1 or late").select("x", "y", "first", F.coalesce("late", F.lit(False)).alias("late"))
    cut = lines.select("at", "x", "y").join(gone, ["x", "y"]).where("late or first < at")
    return cut.groupBy("at.doc_id", "at.t").agg(F.array_sort(F.collect_set("at.pos")).alias("removed"))


@shielded
def line_dedup(docs: DataFrame, keep_text: bool = True, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with n_lines, n_removed, removed and, unless ``keep_text`` is false,
    kept_text in place of the text.

    A line (between line feeds) goes when an equal one, or one of ``shortest``
    characters or more within one edit of it, stands earlier: in a document with
    a smaller id, or earlier in the same.  Lines are judged on the input.

    Lines without a word stay and count as lines; a null text has none, an empty
    one has one; null ids come last; rows with equal ids and texts are cut alike;
    an empty table gives an empty one.  Columns that bear an output's name are
    replaced; with ``keep_text`` false no text is moved at the end.
    """
    base = without(docs, "n_lines", "n_removed", "removed", "kept_text").withColumn("__t", F.xxhash64("text"))
    base = base.withColumn("n_lines", F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long"))
    base = base if keep_text else base.drop("text")
    lost = duplicate_lines(docs, shortest).select(F.col("doc_id").alias("__id"), F.col("t").alias("__x"), "removed")
    out = base.join(lost, base["doc_id"].eqNullSafe(lost["__id"]) & (base["__t"] == lost["__x"]), "left").drop("__t", "__id", "__x")
    out = out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>"))).withColumn("n_removed", F.size("removed").cast("long"))
    if keep_text:
        kept = F.filter(F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.sequence(F.lit(0), F.size(F.split("text", "\n", -1)) - 1).alias("at")), lambda z: ~F.array_contains("removed", z["at"]))
        out = out.withColumn("kept_text", F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda z: z["line"]), "\n"))).drop("text")
    return out
