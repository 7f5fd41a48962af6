"""Token counts (operator 10) by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, without

#: Pre-tokens a worker remembers, and letters of the longest it does; the memory is
#: emptied beyond that, and longer ones are counted each time.
REMEMBERED, LONGEST = 400_000, 48
_counters: dict[str, "Counter"] = {}


class Counter:
    """Counts the pieces of a byte-fallback BPE model.

    A text is cut into pre-tokens at blanks; those not yet known are counted in
    one batch as ragged arrays of symbols.  They are cut again wherever no piece
    of the vocabulary holds the two neighbouring characters, for no merge can
    cross such a place.  In each round every sequence merges at once all pairs that
    are lowest in rank among whatever may come to overlap them, and whose merging
    makes nothing lower: one after the other they would come out the same.  A
    sequence without such a pair merges its lowest, the leftmost of them.  What is
    left when no pair has a rank is counted, a character that is no piece as its
    UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        score = np.array([sp.get_score(i) for i in ids])
        rank = dict(zip(pieces, np.unique(-score, return_inverse=True)[1].tolist(), strict=True))
        # symbols: the pieces, numbered; single characters are looked up by code point
        number = {p: k for k, p in enumerate(pieces)}
        self.char = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.char[ord(p)] = k
        # all ways in which two symbols make a piece, also symbols that are no pieces but single characters
        self.n = len(pieces)
        keys, ranks, made = [], [], []
        before: dict[int, int] = {}
        after: dict[int, int] = {}
        for p, k in number.items():
            for i in range(1, len(p)):
                a, b = self._symbol(p[:i], number), self._symbol(p[i:], number)
                if a is None or b is None:
                    continue
                keys.append((a << 32) | b)
                ranks.append(rank[p])
                made.append(k)
                # what stands beside b may become a as long as it ends it, and so with a and b
                for j in range(i):
                    x = self._symbol(p[j:i], number)
                    if x is not None:
                        at = (b << 32) | x
                        before[at] = min(before.get(at, rank[p]), rank[p])
                for j in range(i + 1, len(p) + 1):
                    x = self._symbol(p[i:j], number)
                    if x is not None:
                        at = (a << 32) | x
                        after[at] = min(after.get(at, rank[p]), rank[p])
        #: The lowest rank that a symbol can have with what may come to stand before
        #: it, or after it, by the symbol that stands there now.
        self.before, self.after = (self._table(t) for t in (before, after))
        #: Hashes of all that stands within pieces: a place that is within none is never crossed.
        self.power = np.uint64(0x9E3779B97F4A7C15) ** np.arange(64, dtype=np.uint64)
        self.name = np.zeros(self.n, np.uint64)
        self.size = np.fromiter(map(len, pieces), np.int64, self.n)
        within = set()
        for k, p in enumerate(pieces):
            for i in range(len(p)):
                h = 0
                for c in p[i:]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                    within.add(h)
                if i == 0:
                    self.name[k] = h
        self.within = np.sort(np.fromiter(within, np.uint64, len(within)))
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.made = np.array(made, np.int64)[order]
        near = {(ord(p[i]) << 21) | ord(p[i + 1]) for p in pieces for i in range(len(p) - 1)}
        self.near = np.array(sorted(near), np.int64)
        self.known: dict[str, int] = {}
        self.blank = "▁"
        self.prefix = self._prefix()
        #: What a text becomes before it is cut, as the model's own normaliser does it.
        self.normal = sp.normalize if self._normalises() else None

    def _symbol(self, s: str, number: dict) -> int | None:
        return number.get(s, self.n + ord(s) if len(s) == 1 else None)

    @staticmethod
    def _table(lowest: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(lowest, np.int64, len(lowest))
        ranks = np.fromiter(lowest.values(), np.int64, len(lowest))
        order = np.argsort(keys)
        return keys[order], ranks[order]

    def _prefix(self) -> bool:
        return self.sp.normalize("a").startswith(self.blank)

    def _normalises(self) -> bool:
        """Whether more is done than to put the blank mark for spaces."""
        probe = "  Ⅰ Ａ\tÅ é \r\n　 "
        return self.sp.normalize(probe) != self.blank * self.prefix + probe.replace(" ", self.blank)

    def counts(self, texts: list[str]) -> list[int]:
        known, cut = self.known, []
        fresh: set[str] = set()
        for t in texts:
            if not t:
                cut.append([])
                continue
            # the blank mark itself, in a text, is a blank to the model
            words = self.normal(t).split(self.blank)[self.prefix :] if self.normal else t.replace(self.blank, " ").split(" ")
            cut.append((not self.prefix, words))
            fresh.update(words)
        fresh.difference_update(known)
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = {w for c in cut if c for w in c[1]}
        if fresh:
            new = sorted(fresh)
            known.update(zip(new, self.count_words(new).tolist(), strict=True))
        out = [self._total(*c) if c else 0 for c in cut]
        for w in fresh:
            if len(w) > LONGEST:
                del known[w]
        return out

    def _total(self, head: bool, words: list[str]) -> int:
        """Words stand after a blank each, the first too unless ``head``; blanks in
        a row are one pre-token with the word that follows them."""
        if "" not in words and not head:
            return sum(map(self.known.__getitem__, words))
        total, blanks, odd = 0, 0, []
        for i, w in enumerate(words):
            blanks += not (head and i == 0)
            if w == "" and i < len(words) - 1:
                continue
            if blanks == 1 and w:
                total += self.known[w]
            elif blanks or w:
                odd.append(self.blank * blanks + w)
            blanks = 0
        return total + (int(self.count_raw(odd).sum()) if odd else 0)

    def count_words(self, words: list[str]) -> np.ndarray:
        return self.count_raw([self.blank + w for w in words])

    def count_raw(self, tokens: list[str]) -> np.ndarray:
        """Pieces of each pre-token."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        code = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
        seq = np.repeat(np.arange(len(tokens)), sizes)
        symbol = self.char[code].astype(np.int64)
        bytes_ = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        cost = np.where(symbol < 0, bytes_, 1)
        symbol = np.where(symbol < 0, self.n + code, symbol)
        total = np.bincount(seq, cost, len(tokens)).astype(np.int64)
        if len(code) < 2:
            return total
        # places that no merge can cross
        pair = (code[:-1] << 21) | code[1:]
        tied = (seq[:-1] == seq[1:]) & self._among(pair, self.near)
        group = np.concatenate(([0], np.cumsum(~tied)))
        total -= self._saved(symbol, cost, group, seq, len(tokens))
        return total

    @staticmethod
    def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return table[at] == x

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], np.iinfo(np.int64).max), at

    def _saved(self, symbol: np.ndarray, cost: np.ndarray, group: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        """By how much merging lowers the cost of each pre-token."""
        saved = np.zeros(n, np.int64)
        while len(symbol) > 1:
            where = np.flatnonzero(group[:-1] == group[1:])
            rank, at = self._rank(symbol[where], symbol[where + 1])
            ranked = rank < np.iinfo(np.int64).max
            where, rank, at = where[ranked], rank[ranked], at[ranked]
            if not len(where):
                break
            best = self._merged(where, rank, self.made[at], symbol, group)
            spot = where[best]
            np.add.at(saved, seq[spot], cost[spot] + cost[spot + 1] - 1)
            symbol[spot] = self.made[at[best]]
            cost[spot] = 1
            alive = np.zeros(int(group[-1]) + 1, bool)  # groups without a ranked pair are finished
            alive[group[where]] = True
            stay = alive[group]
            stay[spot + 1] = False
            symbol, cost, group, seq = symbol[stay], cost[stay], group[stay], seq[stay]
            if len(symbol) > 1 and 16 * len(spot) < len(stay):  # few places were ready: more and smaller groups have more
                group = self._regrouped(symbol, group)
        return saved

    def _lowest(self, table: tuple[np.ndarray, np.ndarray], own: np.ndarray, beside: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The lowest rank that ``own`` can get with what becomes of ``beside``."""
        keys, ranks = table
        key = (own << 32) | beside
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(there & (keys[at] == key), ranks[at], np.iinfo(np.int64).max)

    def _merged(self, where: np.ndarray, rank: np.ndarray, made: np.ndarray, symbol: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which of the ranked pairs, in order of place, are merged in this round.

        A pair is ready if its rank is below any that its left or right symbol can
        come to have with its neighbour, so nothing overlapping goes first, and the
        piece made has only higher ranks with its neighbours, so nothing comes of it
        before its time.  A run of one symbol is taken by twos from its left, as far
        as pairs are ready but for their like.
        """
        a, b, g = symbol[where], symbol[where + 1], group[where]
        lead, tail = np.maximum(where - 1, 0), np.minimum(where + 2, len(symbol) - 1)
        has_l, has_r = (where > 0) & (group[lead] == g), (where + 2 < len(symbol)) & (group[tail] == g)
        left, right = symbol[lead], symbol[tail]
        twin = a == b
        low, high = self._lowest(self.before, a, left, has_l), self._lowest(self.after, b, right, has_r)
        ready = (rank < low) | (twin & has_l & (left == a) & (rank == low))
        ready &= (rank < high) | (twin & has_r & (right == a) & (rank == high))
        ready &= (rank < self._lowest(self.before, made, left, has_l)) & (rank < self._lowest(self.after, made, right, has_r))
        # runs of pairs of the same symbol
        on = np.zeros(len(where), bool)
        on[1:] = twin[1:] & (a[1:] == a[:-1]) & twin[:-1] & (where[1:] == where[:-1] + 1)
        begin = np.flatnonzero(~on)
        number = np.cumsum(~on) - 1
        fails = np.cumsum(~ready)
        so_far = fails - (fails - ~ready)[begin][number]  # of the run, itself included
        take = (so_far == 0) & ((np.arange(len(where)) - begin[number]) % 2 == 0)
        # groups in which none is ready
        new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        of = np.cumsum(np.concatenate(([True], g[1:] != g[:-1]))) - 1
        idle = np.add.reduceat(take, new) == 0
        if idle.any():
            least = np.minimum.reduceat(rank, new)
            first = np.flatnonzero((rank == least[of]) & idle[of])
            take[first[np.concatenate(([True], of[first][1:] != of[first][:-1]))]] = True
        return np.flatnonzero(take)

    def _regrouped(self, symbol: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Groups cut where two neighbours stand side by side in no piece."""
        raw = symbol >= self.n
        kept = np.where(raw, 0, symbol)
        name = np.where(raw, (symbol - self.n + 1).astype(np.uint64), self.name[kept])
        size = np.where(raw, 1, self.size[kept])
        both = name[:-1] * self.power[np.minimum(size[1:], 63)] + name[1:]
        at = np.minimum(np.searchsorted(self.within, both), len(self.within) - 1)
        tied = (group[:-1] == group[1:]) & (self.within[at] == both)
        return np.concatenate(([0], np.cumsum(~tied)))


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less its text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``model`` is the path of a sentencepiece BPE model with byte fallback, which
    every executor can read.  No begin, end or added tokens; strings that look
    like special tokens are text; no truncation.

    A null text counts as an empty one, which has no tokens; texts of any length
    are counted whole; repeated rows are counted each; an empty table gives an
    empty one.  Columns that bear an output's name are replaced.
    """
    kept = without(docs, "n_bytes", "n_tokens", "over_limit")
    schema = kept.drop(text_col).withColumn("n_bytes", F.lit(0).cast("long")).withColumn("n_tokens", F.lit(0).cast("long")).withColumn("over_limit", F.lit(True)).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for whole in batches:
            for batch, texts in chunks(whole, text_col, 4 << 20):
                n = np.array(c.counts([t.decode() for t in texts]), np.int64)
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                rest = [x for name, x in zip(batch.schema.names, batch.columns, strict=True) if name != text_col]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(size), pa.array(n), pa.array(n > limit)], names=schema.names)

    return kept.mapInArrow(count, schema)
