"""Quality classifier (operator 11): ridge regression on random Fourier features of
document statistics, from normal equations summed by partition, then isotonic
calibration."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, gram_hashes, shielded, staged, without, word_hashes

#: Random features, their kernel's width (in standard deviations for each root of a
#: statistic), the ridge, folds for calibration, and levels of a score that it tells apart.
FEATURES, WIDTH, RIDGE, FOLDS, LEVELS = 256, 3.0, 0.3, 5, 2000
#: Statistics further from the mean than this many deviations count as so far.
FAR = 6.0


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes counted by kind.
_KINDS = {
    "upper": _class((65, 90)),
    "lower": _class((97, 122)),
    "digit": _class((48, 57)),
    "blank": _class((9, 9), (11, 13), (32, 32)),
    "line": _class((10, 10)),
    "stop": _class((44, 44), (46, 46), (58, 59), (63, 63)),
    "shout": _class((33, 33)),
    "bar": _class((124, 124)),
    "sign": _class((34, 43), (45, 45), (47, 47), (60, 62), (64, 64), (91, 96), (123, 123), (125, 126)),
    "control": _class((0, 8), (14, 31), (127, 127)),
    "far": _class((128, 255)),
}
NAMES = [
    "size", "words", *_KINDS, "far_upper", "word_length", "word_spread", "short", "long", "joined", "distinct",
    "commonest", "repeated", "distinct_pairs", "line_words",
]


def numbers(texts: list[bytes]) -> np.ndarray:
    """The statistics of each text, in the order of NAMES: logarithms of sizes, roots of
    shares.  A text without bytes or words has zeros in their place."""
    n = len(texts)
    size = np.fromiter((len(t) for t in texts), np.int64, n)
    buf = np.frombuffer(b"".join(texts) + b"\n", np.uint8)
    begin = np.cumsum(size) - size
    some = np.flatnonzero(size)
    out = np.zeros((n, len(NAMES)))

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(n)
        if len(some):
            sums[some] = np.add.reduceat(flags[:-1], begin[some], dtype=np.int64)
        return sums

    share = lambda a, b: np.sqrt(np.divide(a, b, out=np.zeros(n), where=b > 0))
    column = {"size": np.log1p(size)}
    counts = {k: total(table[buf]) for k, table in _KINDS.items()}
    column |= {k: share(c, size) for k, c in counts.items()}
    capital = np.concatenate(([False], (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)))
    letters = counts["upper"] + counts["lower"] + counts["far"]
    column["far_upper"] = share(counts["upper"] + total(capital), letters)

    words, doc = word_hashes(texts)
    per = np.bincount(doc, minlength=n).astype(float)
    column["words"] = np.log1p(per)
    space = _KINDS["blank"] | _KINDS["line"]
    joined = b"\n".join(texts) + b"\n"
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space[np.frombuffer(joined, np.uint8)]))))
    length = (edge[1::2] - edge[0::2]).astype(float)
    of = lambda x: np.bincount(doc, x, minlength=n)
    mean = np.divide(of(length), per, out=np.zeros(n), where=per > 0)
    column["word_length"] = np.log1p(mean)
    column["word_spread"] = share(np.sqrt(of((length - mean[doc]) ** 2)), np.sqrt(per) * (1 + mean))
    column["short"], column["long"] = share(of(length <= 3), per), share(of(length > 20), per)
    # words that end in anything but a letter, a digit or a stop
    text = np.frombuffer(joined, np.uint8)
    last = text[edge[1::2] - 1] if len(length) else np.empty(0, np.uint8)
    plain = _KINDS["upper"] | _KINDS["lower"] | _KINDS["digit"] | _KINDS["far"] | _KINDS["stop"]
    column["joined"] = share(of(~plain[last]), per)
    for name, h, at in (("distinct", words, doc), ("distinct_pairs", *_pairs(words, doc))):
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])))) if len(h) else np.empty(0, np.int64)
        all_ = np.bincount(at, minlength=n).astype(float)
        column[name] = share(np.bincount(at[new], minlength=n).astype(float), all_)
        if name == "distinct":
            most = np.zeros(n)
            np.maximum.at(most, at[new], np.diff(np.concatenate((new, [len(h)]))))
            column["commonest"] = share(most, all_)
    again = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1]) if len(words) else np.empty(0, bool)
    column["repeated"] = share(np.bincount(doc[1:][again], minlength=n).astype(float), per)
    column["line_words"] = np.log1p(per / (1 + counts["line"]))
    for i, name in enumerate(NAMES):
        out[:, i] = column[name]
    return out


def _pairs(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, first = gram_hashes(words, doc, 2)
    return h, doc[first]


@shielded
def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats``, the statistics of each whole text, in place of the text;
    written, so that the texts are read once for training and scoring.  A null text is
    empty; repeated rows give a row each; a column called ``stats`` is replaced."""
    rest = [c for c in docs.columns if c != text_col and c.lower() != "stats"]
    base = docs.select(*[F.col(c) for c in rest], F.col(text_col).alias("__t"))
    schema = base.drop("__t").withColumn("stats", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in chunks(whole, "__t", 4 << 20):
                x = numbers(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), lists], names=schema.names)

    return staged(base.mapInArrow(run, schema), "stats")


class Model:
    """Means and deviations of statistics, weights of random features, and the levels of
    the calibration: probability ``height`` at raw scores ``at``."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None, at: np.ndarray, height: np.ndarray, seed: int = 11):
        self.mean, self.scale, self.weights, self.at, self.height, self.seed = mean, scale, weights, at, height, seed
        self._draw()

    def _draw(self) -> None:
        rng = np.random.default_rng(self.seed)
        d = len(NAMES)
        self.w = rng.standard_normal((d, FEATURES)) / (WIDTH * np.sqrt(d))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __getstate__(self):
        return self.mean, self.scale, self.weights, self.at, self.height, self.seed

    def __setstate__(self, state):
        self.__init__(*state)

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Cosines whose products approximate a Gaussian kernel, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -FAR, FAR)
        return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))), axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.height[0])
        raw = self.fourier(x) @ self.weights
        # a thousandth by the raw score, so that rows of one pool keep their order
        return 0.999 * np.interp(raw, self.at, self.height) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)


def held_out(name: str = "doc_id"):
    """Whether a row's label is kept from training; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def isotonic(at: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (score, probability) at the first and last score of each
    pool, from ascending scores with their rows and good rows.  Half a row of either kind
    is added to a pool, so no probability is 0 or 1."""
    pools: list[list[float]] = []  # rows, good rows, first score, last score
    for x, rows, yes in zip(at.tolist(), n.tolist(), good.tolist(), strict=True):
        pools.append([rows, yes, x, x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            rows, yes, _, x = pools.pop()
            pools[-1] = [pools[-1][0] + rows, pools[-1][1] + yes, pools[-1][2], x]
    p = np.array(pools)
    return p[:, 2:].ravel(), np.repeat(np.maximum.accumulate((p[:, 1] + 0.5) / (p[:, 0] + 1)), 2)


def _equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Normal equations (features by features, and a last column of targets) of each
    fold, summed by partition and then by treeAggregate."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    d = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, d, d + 1))
        for batch in batches:
            x = shared.value.fourier(_array(batch))
            fold, y = batch.column("fold").to_numpy(), batch.column("quality").to_numpy()
            for k in range(FOLDS):
                z = x[fold == k]
                total[k, :, :d] += z.T @ z
                total[k, :, d] += z.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    sums = rows.select("stats", "fold", "quality").mapInArrow(run, "sums binary").rdd
    return sums.treeAggregate(np.zeros((FOLDS, d, d + 1)), lambda a, row: a + pickle.loads(row[0]), lambda a, b: a + b, 3)


def _array(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(NAMES))


def _solved(equations: np.ndarray, ridge: float) -> np.ndarray:
    d = equations.shape[0]
    keep = np.full(d, ridge)
    keep[-1] = 1e-3  # the constant
    return np.linalg.solve(equations[:, :d] + np.diag(keep), equations[:, d])


def train(stats: DataFrame, labels: DataFrame, ridge: float = RIDGE) -> Model:
    """A model from all labelled rows that aren't held out, by their statistics.

    Labels with a null id or value are not used; an id labelled more than once is good
    if any label says so; rows that share an id are all used.  Without rows of both kinds
    every text gets the same score.

    The scores that the calibration is fitted on are each row's by the model of the
    other folds (rows with equal statistics share one), counted on LEVELS levels.
    """
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where(~held_out())
    fold = F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = staged(stats.select("doc_id", "stats").join(labels, "doc_id").select("stats", fold, F.col("quality").cast("double").alias("quality")), "labelled")
    sums = rows.agg(F.count("*").alias("n"), F.sum("quality").alias("good"), *[f(F.get("stats", F.lit(i))).alias(f"{k}{i}") for i in range(len(NAMES)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, good = sums["n"], sums["good"] or 0
    if not n or good in (0, n):
        discard(rows)
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), None, np.zeros(1), np.array([(good + 0.5) / (n + 1)]))
    mean, spread = (np.array([sums[f"{k}{i}"] for i in range(len(NAMES))]) for k in "ms")
    model = Model(mean, np.where(spread > 1e-6, spread, 1.0), None, np.zeros(1), np.zeros(1))
    equations = _equations(rows, model)
    every = equations.sum(axis=0)
    model.weights = _solved(every, ridge)
    others = rows.sparkSession.sparkContext.broadcast((model, np.array([_solved(every - part, ridge) for part in equations])))

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = others.value
        for batch in batches:
            raw = (own.fourier(_array(batch)) * weights[batch.column("fold").to_numpy()]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.rint((raw + 0.5) * LEVELS / 2), 0, LEVELS).astype(np.int32)), batch.column("quality")], names=["level", "quality"])

    counted = rows.mapInArrow(levels, "level int, quality double").groupBy("level").agg(F.count("*").alias("n"), F.sum("quality").alias("good")).orderBy("level").collect()  # LEVELS + 1 rows
    discard(rows)
    at = np.array([r["level"] for r in counted]) * 2 / LEVELS - 0.5
    model.at, model.height = isotonic(at, np.array([r["n"] for r in counted], float), np.array([r["good"] for r in counted]))
    return model


def score(stats: DataFrame, model: Model, at_least: float = 0.3) -> DataFrame:
    """Rows of :func:`statistics` with score (0 to 1, higher: likelier good) and predicted
    (1 from ``at_least``), in place of the statistics.  Empty texts are scored by their
    statistics like any other; repeated rows get the same score each; an empty table
    gives an empty one.  Columns that bear an output's name are replaced."""
    base = without(stats, "score", "predicted")
    shared = stats.sparkSession.sparkContext.broadcast(model)
    schema = base.drop("stats").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(_array(batch))
            kept = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s), pa.array((s >= at_least).astype(np.int32))], names=schema.names)

    return base.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, less their text, with score and predicted by a model of ``labels``."""
    found = statistics(docs)
    return score(found, train(found, labels))
