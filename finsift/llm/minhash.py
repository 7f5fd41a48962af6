"""MinHash near-deduplication (operator 7): improved consistent weighted sampling
over TF-IDF shingles, bands, and verification by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, chunks, connected_components, discard, gram_hashes, lists, mix, require_integers, shielded, spanning, staged, without, word_hashes

#: BANDS bands of ROWS samples: a pair of weighted similarity 0.8 meets in one with
#: probability 0.9982, one of 0.5 with 0.54 and one of 0.1 with 0.0012.
BANDS, ROWS = 12, 4
#: A shingle in fewer than this share of all documents weighs as one in that share,
#: whatever the corpus.
RAREST = 1e-2
#: Bytes of text that are counted together, and for each slice of shingles.
PIECE, SLICE = 16 << 20, 4 << 20
#: Random triples of the sampler; each sample draws from them by its own hash.
TRIPLES_BITS = 14
#: Texts, and their total weight, that one block of a bucket holds; texts compared
#: with one copy of a bucket's first.
BLOCK, BLOCK_WEIGHT, SHARE = 512, 4_000_000, 256
#: Numbers of texts whose rows all lack an id begin here.
UNNAMED = 1 << 62


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times) of each text's distinct shingles of n words, in order of
    row and shingle.  A text of fewer words is one shingle of all its words."""
    words, doc = word_hashes(texts)
    h, first = gram_hashes(words, doc, n)
    own = doc[first]
    size = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        start = np.concatenate(([0], np.cumsum(size)))[short]
        whole = np.array([int(np.add.reduce(words[a : a + k] * np.arange(1, 2 * k, 2, dtype=np.uint64))) for a, k in zip(start, size[short], strict=True)], np.uint64)
        h, own = np.concatenate((h, mix(whole))), np.concatenate((own, short))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return own[at], h[at], np.diff(np.concatenate((at, [len(h)])))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(x, y, node, copies, text) of the distinct texts of ``docs`` (doc_id, text, x,
    y), written.  A text's node is its least doc_id, or a number from UNNAMED on."""
    node = F.coalesce(F.min("doc_id"), F.lit(UNNAMED) + F.col("x").bitwiseAND(F.lit(UNNAMED - 1)))
    return staged(docs.groupBy("x", "y").agg(node.alias("node"), F.count("*").alias("copies"), F.first(F.coalesce("text", F.lit(""))).alias("text")), "unique")


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order with the sums of their counts."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n


def _packed(sets: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    h, n = (pa.array([x[i].tobytes() for x in sets], pa.binary()) for i in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in sets], pa.int64()), h, n], names=["slice", "h", "n"])


def _counted(texts: DataFrame, n: int, bits: int, choose) -> DataFrame:
    """(slice, h, n): for blocks of PIECE bytes of text, the shingles that
    ``choose(h, n, bytes)`` picks with the documents of the block that hold them,
    by the high ``bits`` of the shingle and packed."""

    def emit(held: list, size: int) -> pa.RecordBatch:
        h, k = _summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        some = choose(h, k, size)
        h, k = h[some], k[some]
        cuts = np.searchsorted(h >> np.uint64(63 - bits) >> np.uint64(1), np.arange((1 << bits) + 1, dtype=np.uint64))
        return _packed([(int(i), h[cuts[i] : cuts[i + 1]], k[cuts[i] : cuts[i + 1]]) for i in np.flatnonzero(np.diff(cuts))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch, some in chunks(whole, "text", 1 << 20):
                own, h, _ = shingles(some, n)
                held.append(_summed(h, batch.column("copies").to_numpy()[own]))
                size += sum(map(len, some))
                if size >= PIECE:
                    yield emit(held, size)
                    held, size = [], 0
        if held:
            yield emit(held, size)

    return texts.select("copies", "text").mapInArrow(run, "slice long, h binary, n binary")


def _sums_over(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with sums of ``least`` or more, in order: a table bounded as
    :func:`document_weights` says."""

    def total(t: pa.Table) -> pa.Table:
        h, n = (np.concatenate([np.frombuffer(v, d) for v in t[c].to_pylist()]) for c, d in (("h", np.uint64), ("n", np.int64)))
        h, n = _summed(h, n)
        return pa.Table.from_batches([_packed([(t["slice"][0].as_py(), h[n >= least], n[n >= least])])])

    rows = counts.groupBy("slice").applyInArrow(total, "slice long, h binary, n binary").collect()
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, n = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows]), np.concatenate([np.frombuffer(r["n"], np.int64) for r in rows])
    order = np.argsort(h)
    return h[order], n[order]


class Weights:
    """Inverse document frequencies of shingles relative to all documents: 2 for a
    shingle in ``floor`` documents or fewer, falling to 1 for one that is in all.

    They depend on shares of the corpus alone, so two corpora of the same make and
    different sizes weigh a shingle alike.
    """

    def __init__(self, h: np.ndarray, df: np.ndarray, n_docs: int, floor: float):
        self.h = h
        top = np.log(max(n_docs, 2) / floor) if n_docs > floor else 1.0
        self.idf = 1 + (np.log(np.maximum(n_docs, 1) / df) / top).clip(0, 1) if len(h) else np.empty(0)
        #: A quick test by the high bits.
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(h >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), 2.0)
        some = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.h, h[some]), len(self.h) - 1)
            hit = self.h[at] == h[some]
            out[some[hit]] = self.idf[at[hit]]
        return out


def document_weights(texts: DataFrame, n: int, rarest: float = RAREST) -> Weights:
    """Weights of shingles by exact document frequencies over all documents.

    A shingle matters only from ``floor`` documents on.  A block with a share of
    the corpus' bytes counts its shingles and sends those that are in as many of
    its documents as the share of half the floor; what it leaves out adds up to
    less than half the floor over all blocks.  So the shingles with half the floor
    in sight hold all that reach it, and a second pass counts those exactly.
    A mean document of m distinct shingles lets m / ``rarest`` of them reach the floor
    and twice as many half of it: 1.6 KB of table for each of its words at most, whatever
    the number of documents.
    """
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.when(F.col("text").rlike(WORD), F.col("copies"))).alias("docs")).first()
    n_docs, bytes_ = size["docs"] or 0, max(1, size["bytes"] or 0)
    floor = max(1.0, rarest * n_docs)
    bits = int(np.clip(np.ceil(np.log2(bytes_ / SLICE)), 0, 12))
    first = _counted(texts, n, bits, lambda h, k, part: np.flatnonzero(k >= floor / 2 * part / bytes_))
    some, _ = _sums_over(first, floor / 2)
    if not len(some):
        return Weights(some, np.empty(0), n_docs, floor)
    wanted = texts.sparkSession.sparkContext.broadcast(some)

    def known(h: np.ndarray, k: np.ndarray, part: int) -> np.ndarray:
        return np.flatnonzero(np.isin(h, wanted.value, assume_unique=True))

    h, df = _sums_over(_counted(texts, n, bits, known), np.nextafter(floor, np.inf))
    return Weights(h, df, n_docs, floor)


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010).

    For each sample k and shingle s a triple (r, c, b) of Gamma(2,1), Gamma(2,1)
    and uniform numbers depends on k and s alone; with t = floor(ln w / r + b) and
    ln a = ln c - r (t - b) - r, the shingle of least a, with its t, is the sample.
    Two documents agree in a sample with a probability of their weighted Jaccard
    similarity.
    """

    def __init__(self, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = 1 << TRIPLES_BITS
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.lnc = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.b = rng.random(size).astype(np.float32)
        self.odd = (rng.integers(0, 1 << 63, samples, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def __call__(self, starts: np.ndarray, h: np.ndarray, w: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """One key for each band (columns) of each document (rows), from its
        shingles h of weight w, which begin at ``starts``."""
        keys = np.zeros((len(starts), bands), np.uint64)
        lengths = np.diff(np.concatenate((starts, [len(h)])))
        # most shingles have the greatest weight: one table for all of these
        lnw = np.log(w).astype(np.float32)
        top = np.float32(np.log(2.0))
        odd_ones = np.flatnonzero(lnw != top)
        lno = lnw[odd_ones]
        t_top = np.floor(top / self.r + self.b)
        a_top = self.lnc - self.r * (t_top - self.b) - self.r
        shift = np.uint64(64 - TRIPLES_BITS)
        for k in range(bands * rows):
            i = ((h * self.odd[k]) >> shift).astype(np.intp)
            a = a_top[i]
            j = i[odd_ones]
            r, b = self.r[j], self.b[j]
            t_odd = np.floor(lno / r + b)
            a[odd_ones] = self.lnc[j] - r * (t_odd - b) - r
            least = np.minimum.reduceat(a, starts)
            at = np.flatnonzero(a == np.repeat(least, lengths))
            # ties: the shingle of least hash, which is the first
            own = np.searchsorted(starts, at, side="right") - 1
            at = at[np.concatenate(([True], own[1:] != own[:-1]))]
            t = np.floor(lnw[at] / self.r[i[at]] + self.b[i[at]])
            sample = mix(h[at] + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys[:, k // rows] = mix(keys[:, k // rows] + sample + np.uint64(k + 1))
        return keys


def signatures(texts: DataFrame, weights, n: int, bands: int, rows: int) -> DataFrame:
    """(node, x, y, total, keys) of each text: its total weight and band keys; texts
    without words have no keys.  ``weights`` is a broadcast :class:`Weights`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        for whole in batches:
            for batch, some in chunks(whole, "text", 1 << 20):
                own, h, times = shingles(some, n)
                total, keys, with_words = np.zeros(len(some)), np.empty(0, np.uint64), np.unique(own)
                if len(own):
                    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    w = times * weights.value(h)
                    total[with_words] = np.add.reduceat(w, starts)
                    keys = sampler(starts, h, w, bands, rows).reshape(-1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "x", "y")), pa.array(total), lists(keys, np.repeat(with_words, bands), len(some))], names=["node", "x", "y", "total", "keys"])

    return texts.select("node", "x", "y", "text").mapInArrow(run, "node long, x long, y long, total double, keys array<long>")


def _similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (shingles, weights), sorted by shingle."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    least = np.minimum(a[1][at[both]], b[1][both]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def with_heads(pairs: DataFrame, texts: DataFrame, weights, least: float, n: int) -> DataFrame:
    """The links among ``pairs`` (a, b): those of similarity ``least`` or more.

    Pairs are grouped by b, whose text goes before those of its a's, once for
    SHARE of them, so each pair moves one text and no task gets a whole large group.
    """
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("k"))
    text = texts.select(F.col("node").alias("a"), "text")
    mine = pairs.join(shares, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("part"))
    heads = shares.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    rows = mine.unionByName(heads).join(text, "a")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a") != F.col("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, of = [], None
        for whole in batches:
            for batch, some in chunks(whole, "text", 1 << 20):
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                own, h, times = shingles(some, n)
                w, cuts = times * weights.value(h), np.searchsorted(own, np.arange(len(some) + 1))
                near = np.zeros(len(some), bool)
                for i in range(len(some)):
                    this = h[cuts[i] : cuts[i + 1]], w[cuts[i] : cuts[i + 1]]
                    if a[i] == b[i]:  # texts of one id are one document
                        heads = [*(heads if of == b[i] else []), (this[0].copy(), this[1].copy())]
                        of = b[i]
                    else:
                        near[i] = any(_similarity(head, this) >= least for head in heads)
                        of = None
                yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long")


def _entries(texts: list[bytes], weights: Weights, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, weight) of texts as weighted sets: the k-th time of a shingle is a
    member of its own, so that overlaps of sets are sums of lesser counts."""
    own, h, times = shingles(texts, n)
    w = weights(h)
    again = np.repeat(np.arange(len(h)), times)
    k = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
    key = h[again]
    key = np.where(k > 0, mix(key + k.astype(np.uint64)), key)
    return own[again], key, w[again]


def block_links(left: list[bytes], right: list[bytes], comp_left: np.ndarray, comp_right: np.ndarray, weights: Weights, least: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): all pairs of a left and a right text of unlike components whose
    similarity is ``least`` or more.

    What of a text no text of the other side holds can't be shared.  The rest bounds
    the overlap of each pair; only rows with a pair that can reach ``least`` are
    compared, by a product of their incidence matrices in slices.
    """
    i, key_l, w_l = _entries(left, weights, n)
    j, key_r, w_r = _entries(right, weights, n)
    both = np.intersect1d(key_l, key_r)
    none = np.empty(0, np.int64)
    if not len(both):
        return none, none
    total_l, total_r = np.bincount(i, w_l, len(left)), np.bincount(j, w_r, len(right))
    keep_l, keep_r = np.isin(key_l, both), np.isin(key_r, both)
    i, key_l, w_l, j, key_r = i[keep_l], np.searchsorted(both, key_l[keep_l]), w_l[keep_l], j[keep_r], np.searchsorted(both, key_r[keep_r])
    shared_l, shared_r = np.bincount(i, w_l, len(left)), np.bincount(j, w_r[keep_r], len(right))
    need = least / (1 + least) * (total_l[:, None] + total_r[None, :]) - 1e-9
    may = (np.minimum(shared_l[:, None], shared_r[None, :]) >= need) & (comp_left[:, None] != comp_right[None, :])
    rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(rows):
        return none, none
    at_l, at_r = np.full(len(left), -1), np.full(len(right), -1)
    at_l[rows], at_r[cols] = np.arange(len(rows)), np.arange(len(cols))
    keep_l, keep_r = at_l[i] >= 0, at_r[j] >= 0
    i, key_l, w_l, j, key_r = at_l[i[keep_l]], key_l[keep_l], w_l[keep_l], at_r[j[keep_r]], key_r[keep_r]
    order_l, order_r = np.argsort(key_l, kind="stable"), np.argsort(key_r, kind="stable")
    i, key_l, w_l, j, key_r = i[order_l], key_l[order_l], w_l[order_l], j[order_r], key_r[order_r]
    overlap, step = np.zeros((len(rows), len(cols))), 4096
    for start in range(0, len(both), step):
        a, b = np.searchsorted(key_l, (start, start + step))
        c, d = np.searchsorted(key_r, (start, start + step))
        if a < b and c < d:
            x, y = np.zeros((len(rows), step)), np.zeros((step, len(cols)))
            x[i[a:b], key_l[a:b] - start] = w_l[a:b]
            y[key_r[c:d] - start, j[c:d]] = 1.0
            overlap += x @ y
    union = total_l[rows][:, None] + total_r[cols][None, :] - overlap
    hit = may[np.ix_(rows, cols)] & (overlap >= least * union - 1e-12)
    x, y = np.nonzero(hit)
    return rows[x], cols[y]


def _compared(weights, least: float, n: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        left = t["left"].to_numpy()
        node, comp = t["node"].to_numpy(), t["component"].to_numpy()
        texts = [(x or "").encode() for x in t["text"].to_pylist()]
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(r):  # a block with itself
            r = l
        i, j = block_links([texts[k] for k in l], [texts[k] for k in r], comp[l], comp[r], weights.value, least, n)
        a, b = spanning(node[l[i]], node[r[j]])
        return pa.table({"a": a, "b": b})

    return run


def _unfinished(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(bucket, node, component, main, k, ko) of the buckets whose texts are of more
    than one component: main is that of most of them, k the number of blocks of all
    and ko of those outside main.  Buckets of the same texts count once."""
    placed = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = staged(placed, "placed")
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("total").alias("w"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_WEIGHT)).cast("int")
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("s").alias("s"), F.count("*").alias("parts"), F.max_by(F.struct(F.col("component").alias("main"), F.col("n").alias("mn"), F.col("w").alias("mw")), F.struct("n", -F.col("component"))).alias("m")).where("parts > 1")
    whole = whole.groupBy("n", "s").agg(F.min(F.struct("bucket", "w", "m")).alias("b")).select("b.bucket", "b.m.main", blocks(F.col("n"), F.col("b.w")).alias("k"), blocks(F.col("n") - F.col("b.m.mn"), F.col("b.w") - F.col("b.m.mw")).alias("ko"))
    return placed.join(whole, "bucket")


def classes(docs: DataFrame, least: float = 0.8, n: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(x, y, class_id) of the distinct texts of ``docs`` (doc_id, text, x, y), x and y
    hashes of the text; class_id is the least number of the class (:func:`distinct_texts`).

    Equal texts are one node.  Texts that share a bucket of a band are compared
    until each pair of them is of one class or known to be apart, in three steps:
    every text with its buckets' first; in the buckets that are then still of more
    than one class, all texts of a block with each other; and in those of more
    blocks, the texts outside the bucket's main class with all others, block by
    block.  Texts of one class are never compared again, and no pair becomes a row:
    blocks return links only.
    """
    spark = docs.sparkSession
    unique = distinct_texts(docs)
    weights = spark.sparkContext.broadcast(document_weights(unique, n))
    nodes = staged(signatures(unique, weights, n, bands, rows), "nodes")
    banded = nodes.select("node", "total", F.posexplode("keys").alias("band", "key"))
    # buckets with two texts or more
    sizes = banded.groupBy("band", "key").agg(F.min("node").alias("head"), F.count("*").alias("n"), F.min_by("total", "node").alias("head_total")).where("n > 1")
    members = staged(banded.join(sizes.select("band", "key", "head", "head_total"), ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "node", "total", "head", "head_total"), "buckets")
    near = F.least("total", "head_total") >= least * F.greatest("total", "head_total")  # else similarity is below
    pairs = members.where("node <> head").where(near).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    texts = unique.select("x", "y", "text").join(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "x", "y"), ["x", "y"]).select("node", "text")
    texts = staged(texts, "texts")
    discard(unique)
    links = staged(with_heads(pairs, texts, weights, least, n), "links")
    comp = staged(connected_components(links, "near"), "comp")
    compare = _compared(weights, least, n)
    for across in (False, True):
        open_ = _unfinished(members.select("bucket", "node", "total"), comp).join(texts, "node")
        own = F.pmod(F.xxhash64("node", "bucket"), F.col("k")).cast("int")
        if across:
            open_ = open_.where("k > 1").withColumn("own", own)
            out = F.pmod(F.xxhash64("bucket", "node"), F.col("ko")).cast("int")
            apart = open_.where("component <> main").withColumn("i", out).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("left", F.lit(True))
            every = open_.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ko") - 1))).withColumn("j", F.col("own")).withColumn("left", F.lit(False))
            rows_ = apart.unionByName(every)
        else:
            rows_ = open_.withColumn("i", own).withColumn("j", F.lit(-1)).withColumn("left", F.lit(True))
        rows_ = rows_.select("bucket", "i", "j", "left", "node", "component", "text")
        more = staged(rows_.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long"), "links")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        comp = staged(connected_components(links, "near"), "comp")
    return nodes.join(comp, "node", "left").select("x", "y", F.coalesce("component", "node").alias("class_id"))


@shielded
def near_dedup(docs: DataFrame, least: float = 0.8, n: int = 5) -> DataFrame:
    """``docs`` with class_id (the least doc_id of the row's near-duplicate class)
    and kept (whether it is the row that stays).

    Two texts are linked when the weighted Jaccard similarity of their shingles
    of ``n`` words is ``least`` or more, a shingle's weight being its count times
    its inverse document frequency (:class:`Weights`); classes are what links reach.

    Texts with fewer than ``n`` words are one shingle; null and empty texts, and
    those without words, are equal texts each and link with nothing else; rows
    with a null id take part by their text, and where a class has no id at all its
    class_id is null and the rows of one of its texts stay; rows with equal ids are
    one document and stay or go together; an empty table gives an empty one.
    Columns of ``docs`` that bear an output's name are replaced.  Ids that aren't integers
    raise a TypeError.
    """
    require_integers(docs, "doc_id")
    base = without(docs, "class_id", "kept")
    named = base.withColumn("__x", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__y", F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))))
    keys = named.select("doc_id", "text", F.col("__x").alias("x"), F.col("__y").alias("y"))
    found = classes(keys, least, n).select(F.col("x").alias("__i"), F.col("y").alias("__j"), F.col("class_id").alias("__class"))
    rows = named.select("doc_id", F.col("__x").alias("__i"), F.col("__y").alias("__j")).distinct().join(found, ["__i", "__j"])
    # texts of one id are one document: the least class of any of them
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("__class").alias("__least"))
    rows = rows.join(ids, "doc_id", "left").select(F.col("doc_id").alias("__id"), "__i", "__j", F.coalesce("__least", "__class").alias("__class"))
    same = named["doc_id"].eqNullSafe(rows["__id"]) & (named["__x"] == rows["__i"]) & (named["__y"] == rows["__j"])
    out = named.join(rows, same)
    alone = F.col("__class") >= UNNAMED
    first = F.col("__class") == F.lit(UNNAMED) + F.col("__x").bitwiseAND(F.lit(UNNAMED - 1))
    out = out.withColumn("class_id", F.when(~alone, F.col("__class"))).withColumn("kept", F.when(alone, first).otherwise(F.coalesce(F.col("doc_id") == F.col("__class"), F.lit(False))))
    return out.drop("__x", "__y", "__id", "__i", "__j", "__class")
