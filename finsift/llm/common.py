"""Helpers shared by the training-data operators: chunks of text, vectorised word
hashing and distributed connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from finsift.sources.work import remove, shared_dir, stage_path, staged  # noqa: F401 - for the operators

#: White space that separates words everywhere in this subpackage.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`staged` once nothing reads them,
    and have the driver's cleaner drop the shuffles that nothing refers to."""
    for df in frames:
        path = getattr(df, "_finsift_path", None)
        if path:
            remove(df.sparkSession, path)
    if frames:
        clean(frames[0].sparkSession)


def clean(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle when the driver's collector finds it
    unused; between large steps that is not left to chance."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less any column that bears one of the names, in any case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def shielded(operator):
    """An operator that calls its own columns ``__name``, for frames that have columns
    so called: these are out of its way while it runs."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        own = {c: f"{c.strip('_')}_own{i}" for i, c in enumerate(df.columns) if c.startswith("__")}
        return operator(df.withColumnsRenamed(own), *args, **kwargs).withColumnsRenamed({v: k for k, v in own.items()})

    return run


def require_integers(df: DataFrame, name: str) -> None:
    """Ids that are compared as numbers must be such: others raise a TypeError."""
    if not isinstance(df.schema[name].dataType, IntegralType):
        raise TypeError(f"{name} must be of an integer type, not {df.schema[name].dataType.simpleString()}")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def chunks(batch: pa.RecordBatch, name: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with at most about ``limit`` bytes of text each."""
    texts = [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield batch.slice(at, i - at), texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def lists(values: np.ndarray, row: np.ndarray, n: int, kind=pa.int64()) -> pa.ListArray:
    """Values, in the order of their rows, as one list for each of n rows."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))


# ---------------------------------------------------------------- word hashing

_ODD, _ODDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Random numbers for each place in a word, up to PLACES, and byte.  Fixed, so that
#: all workers and all runs agree.
PLACES = 64
_TABLE = np.random.default_rng(0x5EED).integers(0, 1 << 64, PLACES << 8, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of all words of all texts in order, and the number of the
    text that each word is of.

    A word's hash is the mixed sum of a random number for each of its bytes and
    their places (tabulation hashing), so unlike words agree with probability
    2**-64, whatever their form."""
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    value = _TABLE[((place & (PLACES - 1)) << 8) | buf[np.flatnonzero(~space)]]
    if size.max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.uint64) * _ODD)
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _ODDER), np.searchsorted(np.cumsum(lengths), starts, side="right")


def gram_hashes(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the index of each run's first
    word.  Runs of 1, 2, 4 .. words are put together pairwise, mixed at each step."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out, part, width, done = np.full(m, n, np.uint64), words, 1, 0
    while True:
        if n & width:
            out = mix(out * _ODD + part[done : done + m])
            done += width
        if 2 * width > n:
            break
        part = mix(part[:-width] * _ODDER + part[width:])
        width *= 2
    first = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return out[first], first


# -------------------------------------------------------- connected components


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that connect the same: each node of the links with its group's least."""
    ids, node = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = node[: len(a)], node[len(a) :]
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        least = np.minimum(low[x], low[y])
        for at in (x, y, low[x], low[y]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    some = low != np.arange(len(ids))
    return ids[some], ids[low[some]]


def _contracted(links: DataFrame) -> DataFrame:
    """Each partition's links as stars of its own: as many links as nodes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if held:
            a, b = spanning(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) of the graph whose links are the columns ``a`` and ``b``
    (long); component is the least node that can be reached.

    Large-star and small-star steps alternate until no link changes, so rounds
    grow with the logarithm of a component's diameter; before each, partitions
    turn their own links into stars, which saves most rounds.  Each step is an
    aggregation with partial sums and a join that the engine may split at a hot
    node; neighbours are never gathered in one place.  Each round is written to
    the shared folder.
    """

    def written(links: DataFrame) -> tuple[DataFrame, tuple]:
        out = staged(_contracted(links.distinct()), tag)
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e, old = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while old[0]:
        # large star: each node's larger neighbours are tied to its least neighbour
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its lesser neighbours are tied to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new, size = written(small)
        remove(e.sparkSession, e._finsift_path)
        e, done, old = new, old == size, size
        if done:
            break
    return _labels(e)


def _labels(e: DataFrame) -> DataFrame:
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
