"""Phrase collocations (operator 12): suffixes of at most max_n words are shuffled by
language and first word and sorted in descending order, one stack counts all their
prefixes, and the parts of phrases are joined afterwards (Suffix-sigma)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, discard, partitions, staged

#: Bytes of text whose suffixes are counted together before the shuffle, and rows of
#: a batch of them.
CHUNK, ROWS = 16 << 20, 50_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BREAKS = _ENDS.copy()
_BREAKS[[0x20, 0x09]] = True
#: A key is a language and words, each closed by a tab, which no word holds.  Bytes that
#: would sort before it are written as a vertical tab, which no word holds either, and
#: a printable sign; so all keys that begin alike stand side by side.
_TAB, _MARK = "\t", "\x0b"
_CONTROL = bytes(range(0x0E))
_HIDDEN = {c: _MARK + chr(c + 0x30) for c in range(0x0E)}
_SHOWN = {v: chr(k) for k, v in _HIDDEN.items()}


def hide(s: str) -> str:
    return s.translate(_HIDDEN)


def show(s: str) -> str:
    if _MARK not in s:
        return s
    first, *rest = s.split(_MARK)
    return first + "".join(_SHOWN[_MARK + r[0]] + r[1:] for r in rest)


def words_of(texts: list[bytes], langs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, word, piece, language) of all words of all texts: A-Z in lower
    case, pieces cut at punctuation and line ends, words at spaces and tabs."""
    buf = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
    breaks = _BREAKS[buf]
    edge = np.flatnonzero(breaks[1:] != breaks[:-1]) + 1
    if not breaks[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[~breaks])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(_ENDS[buf]), starts)
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, langs[np.searchsorted(limits, starts, side="right")]


def _tokens(batch: pa.RecordBatch, texts: list[bytes]):
    named = batch.column("lang").dictionary_encode()
    return named.dictionary.to_pylist(), *words_of(texts, named.indices.to_numpy(zero_copy_only=False).astype(np.int64))


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def word_totals(docs: DataFrame, share: int) -> DataFrame:
    """(lang, word, n): the number of words of each language (word null), and a count
    of each word that a 2 * ``share``-th of all words are.

    A chunk reports the words that make up a ``share``-th of it, so what it leaves out of
    a word is less than that: the count of such a frequent word is at least half its
    occurrences, and reports are bounded, however many words there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in chunks(whole, "text", CHUNK):
                langs, words, word, _, lang = _tokens(batch, texts)
                pair, n = np.unique(lang * len(words) + word, return_counts=True)
                often = n * share >= len(word)
                sums = np.bincount(lang, minlength=len(langs))
                names = [langs[i] for i in pair[often] // max(1, len(words))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*langs, *names], pa.string()), pa.concat_arrays([pa.nulls(len(langs), pa.string()), words.take(pa.array(pair[often] % max(1, len(words)))).cast(pa.string())]), pa.array(np.concatenate((sums, n[often])))],
                    names=["lang", "word", "n"],
                )

    return _read(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _suffixes(docs: DataFrame, max_n: int, split: dict[tuple[str, str], int]) -> DataFrame:
    """(key, c, split): every suffix of every piece, cut after ``max_n`` words, with its
    number in a chunk of text and the number of tasks that share its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in chunks(whole, "text", CHUNK):
                langs, words, word, piece, lang = _tokens(batch, texts)
                if not len(word):
                    continue
                # equal suffixes get equal numbers, a word more at a time; 0 is the end
                base = len(words) + 1
                code, parts = lang, []
                for i in range(max_n):
                    step = np.zeros(len(word), np.int64)
                    step[: len(word) - i] = np.where(piece[i:] == piece[: len(word) - i], word[i:] + 1, 0)
                    if int(code.max()) >= (1 << 62) // base:
                        code = np.unique(code, return_inverse=True)[1]
                    code = code * base + step
                    parts.append(step)
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                spelled = [b"", *((hide(w.decode()).encode() if w.translate(None, _CONTROL) != w else w) + b"\t" for w in words.to_pylist())]
                spelled, named = pa.array(spelled, pa.binary()), pa.array([(hide(x) + _TAB).encode() for x in langs], pa.binary())
                hot, shares = _hot(langs, words, split)
                for k in range(0, len(first), ROWS):
                    f = first[k : k + ROWS]
                    key = pa.compute.binary_join_element_wise(named.take(pa.array(lang[f])), *(spelled.take(pa.array(p[f])) for p in parts), b"")
                    tasks = np.ones(len(f), np.int32)
                    if len(hot):
                        own = lang[f] * base + parts[0][f]
                        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                        tasks = np.where(hot[at] == own, shares[at], tasks)
                    yield pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(n[k : k + ROWS]), pa.array(tasks)], names=["key", "c", "split"])

    return _read(docs).mapInArrow(run, "key string, c long, split int")


def _hot(langs: list[str], words: pa.Array, split: dict[tuple[str, str], int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, ascending, of a chunk's frequent first words, and their tasks; others have one."""
    some = [(langs.index(x), w.encode(), t) for (x, w), t in split.items() if x in langs]
    at = pa.compute.index_in(pa.array([w for _, w, _ in some], pa.binary()), value_set=words).to_pylist()
    found = sorted((x * (len(words) + 1) + i + 1, t) for (x, _, t), i in zip(some, at, strict=True) if i is not None)
    return np.array([c for c, _ in found], np.int64), np.array([t for _, t in found], np.int32)


class Stack:
    """Counts of the prefixes of sorted keys.  The prefixes of the last key are open,
    the longest on top; a key closes those that it doesn't begin with."""

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least, self.key = max_n, least, b""
        self.open: list[tuple[bytes, int, int]] = []  # prefix, count, split

    def push(self, keys: pa.Array, c: np.ndarray, split: np.ndarray) -> list[tuple]:
        """(prefixes, words, counts, splits) of the prefixes that a batch of keys closes."""
        n = len(keys)
        column = pa.concat_arrays([pa.array([self.key], pa.binary()), keys.cast(pa.binary())])
        offsets = np.frombuffer(column.buffers()[1], np.int32)[: n + 2].astype(np.int64)
        buf = np.frombuffer(column.buffers()[2], np.uint8)[: offsets[-1]]
        before, begin, size = offsets[:-2], offsets[1:-1], np.diff(offsets)
        # bytes that a key shares with the one before it
        shared = np.minimum(size[1:], size[:-1])
        owner = np.repeat(np.arange(n), shared)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(shared) - shared, shared)
        unlike = np.flatnonzero(buf[begin[owner] + place] != buf[before[owner] + place])
        row, first = np.unique(owner[unlike], return_index=True)
        shared[row] = place[unlike[first]]
        # where each key's words end, by its tabs; the first tab closes the language
        tabs = np.flatnonzero(buf[begin[0] :] == 9) + begin[0]
        owner = np.searchsorted(begin, tabs, side="right") - 1
        number = np.arange(len(tabs)) - np.searchsorted(owner, np.arange(n))[owner]
        ends = np.full((n, self.max_n + 1), -1)
        ends[owner, number] = tabs - begin[owner] + 1
        out, still = [], []
        for j in range(1, self.max_n + 1):
            held = self.open[j - 1] if len(self.open) >= j else None
            if held and shared[0] < len(held[0]):
                out.append(([held[0]], j, np.array([held[1]]), np.array([held[2]])))
                held = None
            rows = np.flatnonzero(ends[:, j] >= 0)
            if not len(rows):
                continue
            new = shared[rows] < ends[rows, j]
            new[0] = True  # the first group may go on from the stack
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(c[rows], starts)
            sums[0] += held[1] if held else 0
            own = rows[starts]
            last = len(own) - (rows[-1] == n - 1)
            closed = np.arange(last)
            some = closed[(sums[:last] >= self.least) | ((split[own[:last]] > 1) & (j < self.max_n))]
            out.append(([bytes(buf[begin[r] : begin[r] + ends[r, j]]) for r in own[some].tolist()], j, sums[some], split[own[some]]))
            if last < len(own):
                r = own[last]
                still.append((bytes(buf[begin[r] : begin[r] + ends[r, j]]), int(sums[last]), int(split[r])))
        self.open, self.key = still, bytes(buf[begin[-1] :])
        return out

    def close(self) -> list[tuple]:
        out, self.open, self.key = [([p], j + 1, np.array([c]), np.array([s])) for j, (p, c, s) in enumerate(self.open)], [], b""
        return out


def _counted(suffixes: DataFrame, max_n: int, least: int) -> DataFrame:
    """(key, len, f) of the prefixes of sorted suffixes; those of a first word that
    several tasks share are parts to be summed, others are left out below ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, least)

        def rows(closed: list[tuple]) -> Iterator[pa.RecordBatch]:
            for keys, j, n, split in closed:
                some = (n >= least) | ((split > 1) & (j < max_n))
                column = pa.array(keys, pa.binary()).cast(pa.string()).filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([column, pa.array(np.full(len(column), j, np.int32)), pa.array(n[some])], names=["key", "len", "f"])

        for batch in batches:
            if batch.num_rows:
                yield from rows(stack.push(batch.column("key"), batch.column("c").to_numpy(), batch.column("split").to_numpy()))
        yield from rows(stack.close())

    return suffixes.mapInArrow(run, "key string, len int, f long")


def phrase_counts(docs: DataFrame, max_n: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Written tables (key, len, f) of all phrases of 1 to ``max_n`` words with ``least``
    occurrences within pieces, overlaps included, and (lang, n) of all words.

    Suffixes are counted chunk by chunk of text before the shuffle.  A first word that
    makes up more than half of a task's share of all words is dealt over several tasks
    by the words after it; the counts of its prefixes are summed afterwards.
    """
    spark = docs.sparkSession
    tasks = partitions(spark)
    totals = staged(word_totals(docs, 4 * tasks), "totals")
    langs = totals.where("word is null").select("lang", "n")
    size = langs.agg(F.sum("n")).first()[0] or 0
    hot = totals.where("word is not null").where(F.col("n") * 4 * tasks >= size).collect()  # 4 * tasks words at most
    split = {(r["lang"], r["word"]): 2 + int(r["n"] * 4 * tasks // max(1, size)) for r in hot}
    suffixes = _suffixes(docs, max_n, split)
    place = F.when(F.col("split") > 1, F.pmod(F.xxhash64("key"), "split")).otherwise(0)
    dealt = suffixes.repartition(tasks, F.substring_index("key", _TAB, 2), place).sortWithinPartitions(F.col("key").desc())
    found = _counted(dealt, max_n, least).groupBy("key", "len").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return staged(found, "phrases"), staged(langs, "langs")


def _floor_div(top: str, bottom: str):
    return F.expr(f"({top}) div ({bottom})")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    Texts are lower-cased (A-Z only), cut into pieces at ``. , ; : ! ?`` and line ends
    (0A to 0D) and into words at spaces and tabs.  A phrase of 2 to ``max_n`` words with
    a >= ``least`` occurrences is a candidate; cut after k words it has the parts' counts
    l and r and the score floor(1000000 a a / (l r)), and the cut of least score counts,
    the first of equal ones.  A candidate that lies in a longer one with ``share`` percent
    of its occurrences or more is dropped, whether that one is dropped or not.  Order:
    score, a (both descending), phrase by its bytes.  Exact for a up to 10**15.

    A null text is empty, a null language ``und``; empty texts and languages without
    candidates give no row; repeated rows count each; ids and other columns are not read;
    an empty table gives an empty one.
    """
    found, langs = phrase_counts(docs, max_n, least)
    parts = F.split("key", _TAB, -1)
    named = found.withColumns({"lang": F.get(parts, F.lit(0)), "words": F.slice(parts, F.lit(2), F.col("len"))})

    def key(words):
        return F.concat("lang", F.lit(_TAB), F.array_join(words, _TAB), F.lit(_TAB))

    candidates = named.where("len >= 2")
    cuts = candidates.select("key", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("len") - 1), lambda k: F.struct(k.alias("k"), key(F.slice("words", F.lit(1), k)).alias("first"), key(F.slice("words", k + 1, F.col("len") - k)).alias("rest")))).alias("cut")).select("key", "a", "cut.*")
    cuts = cuts.join(found.select(F.col("key").alias("first"), F.col("f").alias("l")), "first").join(found.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    exact = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    score = cuts.select("key", "a", "l", "r", "k", *[x.alias(f"{c}_") for c, x in exact.items()]).withColumn("score", _floor_div("a_ * a_ * 1000000", "l_ * r_"))
    best = score.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("key", "a", "cut.score", "cut.l", "cut.r")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("len") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("len") - m + 1), lambda s: key(F.slice("words", s, m)))))
    longer = candidates.where("len >= 3").select(F.explode(inner).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    kept = best.join(longer, "key", "left").where(F.coalesce(F.col("longer").cast("decimal(18,0)") * 100 < F.col("a").cast("decimal(18,0)") * share, F.lit(True)))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [k.split(_TAB) for k in b.column("key").to_pylist()]
            lang, phrase = pa.array([show(k[0]) for k in split], pa.string()), pa.array([" ".join(show(w) for w in k[1:-1]) for k in split], pa.string())
            yield pa.RecordBatch.from_arrays([lang, phrase, *(b.column(c) for c in ("a", "l", "r", "score"))], names=["lang", "phrase", "a", "l", "r", "score"])

    kept = kept.select("key", "a", "l", "r", "score").mapInArrow(shown, "lang string, phrase string, a long, l long, r long, score long")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first in slices, so that no task sorts a whole language
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= top).drop("rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    counted = langs.select("lang", "n")
    out = staged(ranked.join(counted, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(found, langs)
    return out
