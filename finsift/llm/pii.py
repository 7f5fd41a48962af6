"""Personal data (operator 3): contextual extraction, bootstrapped from seeds.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged

KINDS = ("email", "ip", "card", "phone")
# The base forms.  Quantifiers are possessive and starts are held to
# the beginning of a run (or the end of the last match), which finds the same
# matches as the plain forms without going back over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base form to be looked for.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: A word that may be an identifier of a form not known: it has a digit or a sign
#: that stands for "at".
MENTION = rf"(?<![^{SPACE}])[^0-9@\[(\x20\x09-\x0D]*+(?:[0-9@]|[\[(]at[\])])[^{SPACE}]*+"
#: Identifiers spelled over several words: numbers in groups, and addresses said in words.
SPREAD = (
    rf"(?<![^{SPACE}])[(]?[0-9]{{2,7}}[)]?(?:\x20?[/-]?\x20?[0-9]{{2,6}}){{1,5}}(?![^{SPACE}.,;:!?])"
    rf"|(?<![^{SPACE}])[A-Za-z0-9._%+-]{{1,64}}+\x20?(?:[\[(]at[\])]|@|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:[\[(]dot[\])]|(?<=\x20)dot(?=\x20)|\.)\x20?[A-Za-z]{{2,24}}+)+"
)
SPREAD_HINT = r"[0-9]{2}[)]?\x20?[/-]?\x20?[0-9]{2}|(?:[\[(]at[\])]|@|\x20at\x20)"
#: What a mention must look like at least to be taken for a kind.
LOOSE = {
    "email": r"^[^@\s]+(?:@|\[at\]|\(at\))[^@\s]+$|^[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)|@|at) ?[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|dot|\.) ?[A-Za-z]{2,})+$",
    "ip": r"^\[?(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}\]?[.,;]?$|^[0-9]+(?:[.,\[\]()-]+[0-9]+){3}[.,;]?$",
    "card": r"^(?:[0-9][-._/ ]?){12,19}[.,;]?$",
    "phone": r"^(?:00)?[(]?(?:[0-9][().\-/ ]*){7,15}[.,;]?$",
}
#: Confidence from which an instance is taken; texts of seeds that a pattern needs.
SURE, SUPPORT = 0.9, 3
_BLOCK = 128


def _spans(text: Column, form: str, hint: str) -> tuple[Column, Column]:
    """Arrays of the parts between the matches of a form, and of the matches."""
    none = F.array().cast("array<string>")
    has = text.rlike(hint)
    return F.when(has, F.split(text, form, -1)).otherwise(none), F.when(has, F.regexp_extract_all(text, F.lit(form), F.lit(0))).otherwise(none)


#: The last two words before a mention, and the first after it.
BEFORE = rf"(?:(?<![^{SPACE}])[^{SPACE}]++[{SPACE}]++)?+(?<![^{SPACE}])[^{SPACE}]++[{SPACE}]*+$"
AFTER = rf"^[{SPACE}]*+[^{SPACE}]++"


def context(left: Column, right: Column) -> tuple[Column, Column]:
    return F.regexp_extract(left, BEFORE, 0).alias("l"), F.regexp_extract(right, AFTER, 0).alias("r")


def _located(parts: str, hits: str) -> Column:
    """Structs (s, e, m, l, r) of matches: code points, end exclusive, the match and
    the words before and after it.  Starts are running sums of lengths, taken by
    blocks so that a text of very many matches costs no square of their number."""
    n = F.size(hits)
    steps = F.transform(F.slice(parts, F.lit(1), n), lambda p, j: F.char_length(p) + F.when(j > 0, F.char_length(F.get(F.col(hits), j - 1))).otherwise(0))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def build(d: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(n / _BLOCK).cast("int")), lambda b: total(F.slice(d, b * _BLOCK + 1, F.lit(_BLOCK))))

        def one(blocks: Column) -> Column:
            def at(m: Column, i: Column) -> Column:
                b = F.floor(i / _BLOCK).cast("int")
                s = total(F.slice(blocks, F.lit(1), b)) + total(F.slice(d, b * _BLOCK + 1, i - b * _BLOCK + 1))
                return F.struct(s.alias("s"), (s + F.char_length(m)).alias("e"), m.alias("m"), *context(F.get(F.col(parts), i), F.get(F.col(parts), i + 1)))

            return F.transform(hits, at)

        return F.element_at(F.transform(F.array(sums), one), 1)

    empty = F.array().cast("array<struct<s:int,e:int,m:string,l:string,r:string>>")
    return F.when(n > 0, F.element_at(F.transform(F.array(steps), build), 1)).otherwise(empty)


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", F.when(n.between(13, 19), digits).otherwise(F.lit("0")))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda x: _valid(kind, x["m"])


def _marked(number: int):
    return lambda x: F.struct(F.lit(number).alias("k"), *[x[c].alias(c) for c in "semlr"])


def _of(number: int):
    return lambda x: x["k"] == number


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __base, the array of (k, s, e, m, l, r) of base identifiers by
    kind and start, and __other, the possible identifiers that overlap none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("__t", text)
    for k in KINDS:
        parts, hits = _spans(F.col("__t"), BASE[k], HINT[k])
        df = df.withColumn("__parts", parts).withColumn("__hits", hits).withColumn(f"__{k}", F.filter(_located("__parts", "__hits"), _passing(k))).drop("__parts", "__hits")
    with_kind = [F.transform(f"__{k}", _marked(i)) for i, k in enumerate(KINDS)]
    df = df.withColumn("__base", F.concat(*with_kind)).drop(*[f"__{k}" for k in KINDS])
    for name, form, hint in (("__words", MENTION, r"[0-9@]|[\[(]at[\])]"), ("__spread", SPREAD, SPREAD_HINT)):
        parts, hits = _spans(F.col("__t"), form, hint)
        df = df.withColumn("__parts", parts).withColumn("__hits", hits).withColumn(name, _located("__parts", "__hits")).drop("__parts", "__hits")
    inner = F.filter("__spread", lambda x: F.contains(x["m"], F.lit(" ")))  # others are words
    df = df.withColumn("__all", F.concat("__words", inner)).drop("__words", "__spread", "__t")
    looks = lambda m: F.greatest(*[m.rlike(LOOSE[k]) for k in KINDS])
    likely = F.filter("__all", lambda x: looks(x["m"]))
    apart = lambda x: ~F.exists("__base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return df.withColumn("__other", F.filter(likely, apart)).drop("__all")


def _patterns(m: str) -> Column:
    """Lexical patterns of a mention: its two words before, the one before, the one after."""
    clean = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    before = clean(F.col(f"{m}.l"))
    two = F.regexp_extract(before, rf"([^{SPACE}]+)[{SPACE}]+([^{SPACE}]+)[{SPACE}]*$", 0)
    one = F.regexp_extract(before, rf"([^{SPACE}]+)[{SPACE}]*$", 1)
    after = F.regexp_extract(clean(F.col(f"{m}.r")), rf"^[{SPACE}]*([^{SPACE}]+)", 1)
    two = F.trim(F.regexp_replace(two, rf"[{SPACE}]+", " "))
    made = F.array(*[F.when(p != "", F.concat(F.lit(f"{name}:"), p)) for name, p in (("before2", two), ("before", one), ("after", after))])
    return F.filter(made, lambda p: p.isNotNull())


def discovered(found: DataFrame) -> DataFrame:
    """(doc_id, x, k, s, e) of identifiers that contexts give away, from rows
    (doc_id, x, __base, __other).

    A seed is of its kind wherever it stands as a word of its own, so also where no
    base form finds it, as beside another number that the form takes with it, and
    a sign that closes a sentence is not part of it.
    Pattern and instance form a two-sided graph.  A pattern's confidence for a
    kind is the share of its instances known to be of that kind; an instance's is
    1 less the product of its patterns' doubts.  An instance that two patterns
    support with SURE in all, and that has the kind's loose form, is known in the
    next round; rounds go on until one makes nothing new known.  Both sides are aggregated with partial sums, so a pattern as
    common as an article costs no more than its rows.
    """
    base = found.select("doc_id", "x", F.explode("__base").alias("m")).select("doc_id", "x", F.col("m.k").alias("k"), "m.s", "m.e", F.lower("m.m").alias("instance"), _patterns("m").alias("p"))
    other = found.select("doc_id", "x", F.explode("__other").alias("m")).select("doc_id", "x", F.lit(None).cast("int").alias("k"), "m.s", "m.e", F.lower("m.m").alias("instance"), _patterns("m").alias("p"))
    mentions = staged(base.unionByName(other), "mentions")
    edges = staged(mentions.select("k", "instance", F.explode("p").alias("pattern")).distinct(), "edges")
    seeds = staged(mentions.where("k is not null").select("instance", "k").distinct(), "seeds")
    known = seeds
    bare = F.regexp_replace("instance", "[.,;:!?]$", "")  # no seed ends in one of these
    fits = [F.when((F.col("k") == i) & F.col("instance").rlike(LOOSE[k]), True) for i, k in enumerate(KINDS)]
    rows = edges.select("instance", "pattern").distinct()
    total = rows.groupBy("pattern").agg(F.count("*").alias("n"))
    best, size = None, 0
    while True:
        right = rows.join(known, "instance").groupBy("pattern", "k").agg(F.count("*").alias("pos")).where(F.col("pos") >= SUPPORT)
        scored = right.join(total, "pattern").withColumn("c", F.col("pos") / (F.col("n") + 1)).where("c >= 0.5")
        open_ = edges.where("k is null").select("instance", "pattern").distinct().join(scored.select("pattern", "k", "c"), "pattern")
        sure = open_.groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("c"), F.count("*").alias("n")).where((F.col("c") >= SURE) & (F.col("n") >= 2))
        sure = sure.where(F.coalesce(*fits, F.lit(False)))
        found = sure.groupBy("instance").agg(F.max_by("k", F.struct("c", -F.col("k"))).alias("k"))
        # seeds are found below, by their own kind
        found = staged(found.withColumn("bare", bare).join(seeds.select(F.col("instance").alias("bare")), "bare", "left_anti").select("instance", "k"), "known")
        # what is known only grows, so a round without growth is the last
        now = found.count()
        best, done, size = found, now <= size, now
        if done:
            break
        known = seeds.union(best)
    rest = mentions.where("k is null").select("doc_id", "x", "s", "e", "instance")
    again = rest.withColumn("e", F.col("e") - F.char_length("instance") + F.char_length(bare)).withColumn("instance", bare)
    return rest.join(best, "instance").unionByName(again.join(seeds, "instance")).select("doc_id", "x", "k", "s", "e")


def private_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) of each row.

    The base identifiers of every whole text are found by their forms; they are the
    seeds of :func:`discovered`, whose finds are added.  n_* count base ones;
    ``spans`` lists all as kind:start:end by kind and start (code points, end
    exclusive), ``base_sha256`` digests the base ones listed so, and ``found`` is
    an array of (kind, start, end).

    A null text is empty; a text without finds has zeros, the digest of an empty
    list and an empty ``spans``; repeated rows and null ids give a row each; an
    empty table gives an empty one; other columns are not read.
    """
    named = docs.select("doc_id", F.col(text_col), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("x"))
    found = staged(base_spans(named, text_col).select("doc_id", "x", "__base", "__other"), "spans")
    new = discovered(found.where((F.size("__base") > 0) | (F.size("__other") > 0)))
    new = new.distinct().groupBy("doc_id", "x").agg(F.collect_list(F.struct("k", "s", "e")).alias("__new")).select(F.col("doc_id").alias("__id"), F.col("x").alias("__x"), "__new")
    out = found.join(new, found["doc_id"].eqNullSafe(new["__id"]) & (found["x"] == new["__x"]), "left")
    short = F.transform("__base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e")))
    names = F.array(*[F.lit(k) for k in KINDS])
    say = lambda a: F.array_join(F.transform(a, lambda b: F.concat_ws(":", F.get(names, b["k"]), b["s"].cast("string"), b["e"].cast("string"))), ",")
    every = F.array_sort(F.concat(short, F.coalesce("__new", F.array().cast("array<struct<k:int,s:int,e:int>>"))))
    return out.select(
        "doc_id",
        *[F.size(F.filter("__base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(say(short), 256).alias("base_sha256"),
        say(every).alias("spans"),
        F.transform(every, lambda b: F.struct(F.get(names, b["k"]).alias("kind"), b["s"].alias("start"), b["e"].alias("end"))).alias("found"),
    )
