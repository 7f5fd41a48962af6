"""Toxicity (operator 4): a Levenshtein automaton walked together with a trie of
learned terms finds them and their misspellings, and the words around a find tell
quotation from abuse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, without

#: Labelled rows that terms are mined from, and that the final weights are fitted on,
#: at most: samples by a hash of the id.  They bound the lexicon.
MINED, SAMPLE = 1_000_000, 20_000
#: Shortest term that may be misspelled, and shortest stem.
FUZZY_FROM, STEM_FROM, STEM_TO = 5, 4, 8
#: Words on either side of a find that are looked at.
CONTEXT = 8
#: Words, letters of the longest of them, and states of the automaton, that are
#: remembered at most.
REMEMBERED, LONGEST, STATES = 400_000, 48, 50_000
_STRIP = ".,;:!?()[]{}<>|/\\*#%&$=+~^`\"'«»“”„‘’‹›…-–—_"
_QUOTES = frozenset("\"«»“”„‘’‹›")
#: Words that introduce what somebody else said, unless others are given.
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quotes quoting word term reported claimed "
    "sagte sagt schrieb nannte zitiert wort dit disait écrit appelé cite citation mot "
    "dijo dice escribió llamó cita palabra".split()
)


def words_of(text: str) -> list[str]:
    """Words in lower case without punctuation at their ends; marks within stay."""
    return [w for w in (t.strip(_STRIP) for t in text.lower().split()) if w]


class Lexicon:
    """A trie of terms and stems, and its product with Levenshtein automata.

    A state is a set of (trie node, edits so far); states are made when a word
    first needs them and kept, so most words end in a dead state after a few
    letters.  A term of FUZZY_FROM letters or more allows one edit; a stem stands
    for every word that begins with it.  ``clean`` are words near a term that
    training rows show to be harmless; ``reporting`` words near a find make it a
    quotation.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean: set[str], reporting: frozenset[str] = REPORTING):
        self.terms, self.stems, self.clean, self.reporting = terms, stems, clean, reporting
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]
        for kind, group in (("term", terms), ("stem", stems)):
            for t in sorted(group):
                node, far = 0, kind == "term" and len(t) >= FUZZY_FROM
                self.fuzzy[0] |= far
                for c in t:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.fuzzy.append(False)
                    node = self.next[node][c]
                    self.fuzzy[node] |= far
                getattr(self, kind)[node] = t
        self._forget()
        self.cache: dict[str, tuple | None] = {}

    def _forget(self) -> None:
        """Begin with no states but the first; others are made again when needed."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple | None] = []
        self.start = self._state({(0, 0)})

    def __getstate__(self):
        return self.terms, self.stems, self.clean, self.reporting

    def __setstate__(self, state):
        self.__init__(*state)

    def _state(self, members: set) -> int:
        """The state of a set, closed under leaving out a letter of a term."""
        full = set(members)
        for node, e in members:
            if e == 0 and self.fuzzy[node]:
                full |= {(n, 1) for n in self.next[node].values() if self.fuzzy[n]}
        key = frozenset(full)
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            found = [(e, 0, self.term[n]) for n, e in key if n >= 0 and self.term[n] and (e == 0 or len(self.term[n]) >= FUZZY_FROM)]
            found += [(0, 1, self.stem[n]) for n, e in key if n >= 0 and e == 0 and self.stem[n]]
            self.ends.append(min(found, default=None))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        new = set()
        for node, e in self.sets[state]:
            n = self.next[node].get(c)
            if n is not None and (e == 0 or self.fuzzy[n]):
                new.add((n, e))
            if e == 0 and self.fuzzy[node]:
                new.add((node, 1))  # a letter too many
                new |= {(m, 1) for m in self.next[node].values() if self.fuzzy[m]}  # another letter
        to = self.moves[state][c] = self._state(new)
        return to

    def match(self, word: str) -> tuple[int, int, str] | None:
        """(edits, whether by a stem, term) of the nearest term, or None."""
        if word in self.cache:
            return self.cache[word]
        if len(self.sets) >= STATES:
            self._forget()
        state, best = self.start, None
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            end = self.ends[state]
            if end and end[1]:
                best = end if best is None else min(best, end)
        if state >= 0 and self.ends[state] and (best is None or self.ends[state] < best):
            best = self.ends[state]
        if best and best[0] and word in self.clean:
            best = None
        if len(word) <= LONGEST:
            if len(self.cache) >= REMEMBERED:
                self.cache.clear()
            self.cache[word] = best
        return best

    def near(self, word: str) -> bool:
        """Whether a word is a misspelling of a term."""
        m = self.match(word)
        return m is not None and m[0] > 0


FEATURES = 7


def features(text: str, lex: Lexicon) -> np.ndarray:
    """Numbers a text is scored by: its finds in abuse and in quotation."""
    out = np.zeros(FEATURES)
    out[0] = 1.0
    words = words_of(text)
    found = {w: m for w in set(words) if (m := lex.match(w))}
    if not found:
        return out
    raw = text.lower().split()
    inside, open_ = [], False
    kept = []
    for t in raw:
        w = t.strip(_STRIP)
        marks = sum(c in _QUOTES for c in t)
        if w:
            kept.append(w)
            inside.append(open_ or marks > 0)
        open_ ^= marks % 2 == 1
    sums = np.zeros(4)
    top = 0.0
    for i, w in enumerate(kept):
        m = found.get(w)
        if m is None:
            continue
        quoted = inside[i] or any(x in lex.reporting for x in kept[max(0, i - CONTEXT) : i + 1 + CONTEXT])
        weight = (lex.stems if m[1] else lex.terms)[m[2]]
        sums[(2 if m[0] else 0) + quoted] += weight
        if not quoted and not m[0]:
            top = max(top, weight)
    out[1:5] = np.log1p(sums)
    out[5] = top
    out[6] = min(1.0, 20 * (sums[0] + sums[2]) / (10 + len(kept)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + keep * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lex: Lexicon, weights: np.ndarray):
        self.lex, self.weights = lex, weights

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(text, self.lex) @ self.weights, -30, 30))))


def held_out(name: str = "doc_id"):
    """Whether a row's label is kept from training; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _uncovered(rows: DataFrame, name: str, stems: DataFrame, proper: bool) -> DataFrame:
    """``rows`` less those whose word ``name`` begins with a stem; with ``proper``,
    with one shorter than the word."""
    begins = F.array_distinct(F.transform(F.sequence(F.lit(STEM_FROM), F.lit(STEM_TO)), lambda k: F.substring(name, F.lit(1), k)))
    if proper:
        begins = F.filter(begins, lambda b: F.length(b) < F.length(name))
    begun = rows.select(F.col(name).alias("__word"), F.explode(begins).alias("__stem"))
    covered = begun.join(stems.select(F.col("stem").alias("__stem")), "__stem", "left_semi").select(F.col("__word").alias(name)).distinct()
    return rows.join(covered, name, "left_anti")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, mined: int = MINED, reporting: frozenset[str] = REPORTING) -> Model:
    """A model from the labelled rows that aren't held out, ``mined`` of them at most.

    Labels with a null id or value, and texts that are null, are not used; an id
    labelled more than once is toxic if any label says so, and so is a text that
    several ids have.  Without toxic rows, or without others, every text gets the
    same score.

    Equal texts count once.  A word is a term, and a beginning that several words
    share a stem, when toxic rows hold it more often than chance allows among as
    many words as there are (a log-likelihood ratio above twice the logarithm of
    their number, plus 4) and at least half of the rows with it are toxic.  All such
    words that begin with no stem are in the lexicon; only they reach the driver.
    """
    spark = docs.sparkSession
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    named = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))
    rows = named.join(labels, "doc_id").groupBy("x", "y").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").cast("int").alias("toxic"))
    rows = staged(rows, "rows")
    known = rows.count()
    if known > mined:
        rows = rows.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 32)) < int((1 << 32) * mined / known))
    # ``mined`` ids at most go to the texts; the other way round all texts would be shuffled
    marked = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(rows.select("doc_id", "toxic")), "doc_id")

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [sorted(set(words_of(t))) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "words"])

    counted = marked.mapInArrow(vocabulary, "toxic int, words array<string>").select("toxic", F.explode("words").alias("word"))
    counts = staged(counted.groupBy("word").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")), "words")
    size = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    n, pos = size["n"], size["pos"] or 0
    if not pos or pos == n:
        discard(counts)
        p = min(max(pos / n if n else 0.05, 0.01), 0.99)
        return Model(Lexicon({}, {}, set(), reporting), np.array([np.log(p / (1 - p))] + [0.0] * (FEATURES - 1)))
    base = pos / n
    ratio = 2 * (F.col("pos") * F.log(F.col("pos") / (F.col("n") * base)) + F.coalesce((F.col("n") - F.col("pos")) * F.log(F.when(F.col("n") > F.col("pos"), (F.col("n") - F.col("pos")) / (F.col("n") * (1 - base)))), F.lit(0.0)))
    least = 2 * np.log(max(2, counts.count())) + 4
    strong = (F.col("pos") > 0) & (F.col("pos") >= F.col("n") * 0.5) & (ratio > least)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (n - pos + 1))
    begun = counts.where(F.length("word") >= STEM_FROM).select("pos", "n", F.explode(F.transform(F.sequence(F.lit(STEM_FROM), F.least(F.lit(STEM_TO), F.length("word"))), lambda k: F.substring("word", F.lit(1), k))).alias("stem"))
    begun = begun.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count_if(F.col("pos") > 0).alias("words")).where("words >= 4").where(strong)
    begun = staged(begun.select("stem", odds.alias("odds")), "stems")
    stems = {r["stem"]: r["odds"] for r in _uncovered(begun, "stem", begun, True).collect()}
    found = counts.where((F.length("word") >= 3) & strong).select("word", odds.alias("odds"))
    terms = {r["word"]: r["odds"] for r in _uncovered(found, "word", begun, False).collect()}
    first = Lexicon(terms, stems, set(), reporting)
    shared = spark.sparkContext.broadcast(first)

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.near(w) for w in batch.column("word").to_pylist()], pa.bool_()))

    # words near a term of which fewer than half the rows are toxic
    clean = {r["word"] for r in counts.where("pos < n * 0.5").select("word").mapInArrow(misspelled, "word string").toLocalIterator()}
    lex = Lexicon(terms, stems, clean, reporting)
    chosen = spark.sparkContext.broadcast(lex)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, chosen.value).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "f"])

    some = docs.select("doc_id", "text").join(F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "toxic")), "doc_id")
    fit = some.mapInArrow(numbers, "toxic int, f array<double>").collect()  # ``sample`` rows
    discard(counts, begun, rows)
    x, y = np.array([r["f"] for r in fit]), np.array([r["toxic"] for r in fit], float)
    return Model(lex, _logistic(x, y))


def score(docs: DataFrame, model: Model, at_least: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic) and predicted (1 from
    ``at_least``), by the text alone.

    Whole texts are read.  Null and empty texts get the score of a text without
    finds; repeated rows the same score each; an empty table gives an empty one.
    Columns that bear an output's name are replaced.
    """
    base = without(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = base.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                s = np.array([shared.value.score(t or "") for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= at_least).astype(np.int32))], names=schema.names)

    return base.mapInArrow(run, schema)
