"""Benchmark decontamination (operator 9): rare word pairs join documents to test items,
and a Smith-Waterman alignment scores the passages around them that can score enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import chunks, gram_hashes, staged, word_hashes

#: Words of the shortest item that is looked for; bytes of test items that one pass over
#: the documents carries.
SHORTEST, BLOCK_BYTES = 3, 16 << 20
#: An alignment's points: an equal word, an unequal one, a word more or less.
EQUAL, UNEQUAL, GAP = 1.0, -1.0, -1.0
_PLAIN = bytes(c if chr(c).isalnum() or c >= 0x80 or c == 0x27 else 0x20 for c in range(256))


def plain(text: bytes) -> bytes:
    """A text as it is compared: lower case, ASCII punctuation as spaces."""
    return text.decode(errors="replace").lower().encode().translate(_PLAIN)


def align(query: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two sequences of word hashes: its points as a share
    of a perfect match, and the first and last word of the passage near it."""
    m = len(query)
    if m == 0 or len(passage) == 0:
        return 0.0, 0, 0
    step = -GAP * np.arange(m + 1)
    row, best, end = np.zeros(m + 1), 0.0, 0
    cell = np.zeros(m + 1)
    for i, word in enumerate(passage):
        cell[1:] = np.maximum(row[:-1] + np.where(query == word, EQUAL, UNEQUAL), row[1:] + GAP)
        np.maximum(cell, 0, out=cell)
        row = np.maximum.accumulate(cell + step) - step  # words of the query left out
        cell = np.zeros(m + 1)
        top = row.max()
        if top > best:
            best, end = float(top), i
    return best / (EQUAL * m), max(0, end - m + 1), end


class Items:
    """A block of test items: word hashes, and the word pairs at each of their places.

    An alignment with c equal words and e errors has e + 1 runs of equal words at most,
    so it holds c - e - 1 of the item's pairs or more: one less than its points.  To
    score ``least`` an item of m words must share ``needed`` = least * m - 1 of its
    m - 1 pairs, hence one at least of its m - ``needed`` rarest.  Those are its seeds;
    no alignment that scores enough is without one.
    """

    def __init__(self, ids: list, texts: list[bytes], least: float, shortest: int):
        words, own = word_hashes([plain(t) for t in texts])
        cuts = np.searchsorted(own, np.arange(len(texts) + 1))
        self.ids, self.least = ids, least
        self.sizes = np.where(np.diff(cuts) >= shortest, np.diff(cuts), 0)
        self.words = [words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.needed = np.maximum(1, np.ceil(least * self.sizes - 1e-9).astype(np.int64) - 1)
        h, first = gram_hashes(words, own, 2)
        kept = self.sizes[own[first]] > 0
        h, first = h[kept], first[kept]
        self.grams, self.gram = np.unique(h, return_inverse=True)  # the pair of each place
        self.item, self.at = own[first], first - cuts[own[first]]
        self.start = np.searchsorted(self.item, np.arange(len(texts) + 1))
        self.sieve = self._sieve(self.grams)
        self.choose(np.zeros(len(self.grams), np.int64))

    def _sieve(self, h: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << min(24, max(16, int(8 * len(h) + 1).bit_length())), bool)
        bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return bits

    def choose(self, seen: np.ndarray) -> None:
        """Take for seeds each item's pairs that documents hold least often, of equally
        frequent ones those of the fewest items."""
        items = np.bincount(self.gram, minlength=len(self.grams))
        order = np.lexsort((self.at, items[self.gram], seen[self.gram], self.item))
        rank = np.arange(len(order)) - self.start[self.item[order]]
        seeds = order[rank < (self.sizes - self.needed)[self.item[order]]]
        seeds = seeds[np.argsort(self.gram[seeds], kind="stable")]
        self.seed_gram, self.seed_item, self.seed_at = self.gram[seeds], self.item[seeds], self.at[seeds]
        self.seed_sieve = self._sieve(self.grams[np.unique(self.seed_gram)])

    def found(self, h: np.ndarray, seeds: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(index, pair) of those hashes that are pairs of items, or may be seeds."""
        sieve = self.seed_sieve if seeds else self.sieve
        at = np.flatnonzero(sieve[(h & np.uint64(len(sieve) - 1)).astype(np.int64)])
        gram = np.minimum(np.searchsorted(self.grams, h[at]), max(0, len(self.grams) - 1))
        same = self.grams[gram] == h[at] if len(self.grams) else np.zeros(len(at), bool)
        return at[same], gram[same]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    rows = benchmark.where("text is not null").select("item_id", "text")
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _prepared(docs: DataFrame, block: DataFrame, least: float, shortest: int):
    """A block's items, whose seeds are their rarest pairs in the documents."""
    sc = docs.sparkSession.sparkContext
    rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=str)  # BLOCK_BYTES at most
    items = Items([r[0] for r in rows], [r[1].encode() for r in rows], least, shortest)
    shared = sc.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        seen = np.zeros(len(it.grams), np.int64)
        for whole in batches:
            for _, texts in chunks(whole, "text"):
                words, doc = word_hashes([plain(t) for t in texts])
                seen += np.bincount(it.found(gram_hashes(words, doc, 2)[0])[1], minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # the block's pairs
    seen = np.zeros(len(items.grams), np.int64)
    seen[counted["gram"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    items.choose(seen)
    shared.destroy()
    return sc.broadcast(items)


def _spans(it: Items, h: np.ndarray, first: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, first word, word after the last) of the passages around seeds, those
    of one row and item joined where they overlap.

    An alignment that scores ``least`` has at most (1 - least) errors for each word
    of the item, so it lies within that many words of each of its seeds' diagonal.
    """
    at, gram = it.found(h, seeds=True)
    lo, hi = np.searchsorted(it.seed_gram, gram, "left"), np.searchsorted(it.seed_gram, gram, "right")
    n = hi - lo
    e = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    where, item = np.repeat(first[at], n), it.seed_item[e]
    row, m = doc[where], it.sizes[item]
    slack = np.floor(m * (1 - it.least)).astype(np.int64) + 1
    begin, end = where - it.seed_at[e] - slack, where - it.seed_at[e] + m + slack
    order = np.lexsort((begin, item, row))
    row, item, begin, end = row[order], item[order], begin[order], end[order]
    # passages of an item are equally long, so the one before ends last
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])))) if len(row) else order
    last = np.concatenate((new[1:], [len(row)])) - 1 if len(row) else order
    row = row[new]
    return row, item[new], np.maximum(starts[row], begin[new]), np.minimum(starts[row + 1], end[last])


def _shared(it: Items, h: np.ndarray, first: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """How many of the pairs at its item's places each passage holds, all at once."""
    at, gram = it.found(h)
    keys = np.sort(gram * size + first[at])
    n = it.start[item + 1] - it.start[item]
    place = np.repeat(it.start[item] - np.cumsum(n) + n, n) + np.arange(n.sum())
    base = it.gram[place] * size
    lo = np.searchsorted(keys, base + np.repeat(a, n))
    held = np.concatenate((keys, [np.iinfo(np.int64).max]))[lo] < base + np.repeat(b, n) - 1
    return np.add.reduceat(held, np.cumsum(n) - n) if len(n) else n


def _matches(it: Items, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, last word) of each pair that scores enough: what
    shares too few pairs is never aligned."""
    words, doc = word_hashes([plain(t) for t in texts])
    h, first = gram_hashes(words, doc, 2)
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    row, item, a, b = _spans(it, h, first, doc, starts)
    if not len(row):
        return []
    some = np.isin(doc[first], row)
    enough = _shared(it, h[some], first[some], item, a, b, len(words) + 1) >= it.needed[item]
    best: dict[tuple[int, int], tuple] = {}
    for r, i, x, y in zip(*(v[enough].tolist() for v in (row, item, a, b)), strict=True):
        score, p, q = align(it.words[i], words[x:y])
        if score >= it.least - 1e-9 and ((r, i) not in best or score > best[r, i][0]):
            best[r, i] = (score, x + p - int(starts[r]), x + q - int(starts[r]))
    return [(*key, *found) for key, found in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of the documents that hold a
    test item, whole or edited.

    ``score`` is the best local alignment's points (1 an equal word, -1 an unequal,
    missing or added one) over the item's words, ``least`` or more; the words
    numbered are those of the text in lower case with punctuation as spaces.
    Items come in blocks of BLOCK_BYTES, two passes over the documents each: one counts
    the items' word pairs, the other joins passages to items by each item's rarest pairs
    and aligns those that share enough pairs.  Nothing that scores ``least`` is missed
    (see :class:`Items`), however common its words.

    Null and empty texts match nothing, nor do items of fewer than ``shortest`` words;
    repeated rows and items are reported each; ids may be null and of any type;
    empty tables give an empty one; other columns are not read.
    """
    names = ["first_word", "last_word"]
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("item_id", benchmark.schema["item_id"].dataType), StructField("score", DoubleType()), *[StructField(c, LongType()) for c in names]])
    types = to_arrow_schema(schema)
    out, blocks = None, _blocks(benchmark)
    for k, block in enumerate(blocks):
        items = _prepared(docs, block, least, shortest)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            it = items.value
            for whole in batches:
                for batch, texts in chunks(whole, "text"):
                    found = _matches(it, texts)
                    row, item, score, a, b = zip(*found, strict=True) if found else ((),) * 5
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array([it.ids[i] for i in item], types.field("item_id").type), pa.array(score, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        names=types.names,
                    )

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        if k < len(blocks) - 1:  # one block's items are held at a time
            found = staged(found, "leaks")
            items.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` less the rows that hold a test item by :func:`find_leaks`; all
    columns stay as they are, and null texts stay."""
    blocks = _blocks(benchmark)
    for k, block in enumerate(blocks):
        items = _prepared(docs, block, least, shortest)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch, texts in chunks(whole, "text"):
                    clean = np.ones(len(texts), bool)
                    clean[[m[0] for m in _matches(items.value, texts)]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if k < len(blocks) - 1:  # one block's items are held at a time
            docs = staged(docs, "clean")
            items.destroy()
    return docs
