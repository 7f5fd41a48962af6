"""Embedding near-deduplication (operator 6): inverted lists with product-quantised
residuals, asymmetric distances over the probed lists and an exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, require_integers, shielded, staged, without

#: Vectors that the lists and codes are fitted on, at most; every vector is indexed.
#: There are sqrt(n / 50) lists but no more than half the sample, so for more than
#: 50 * (sample / 2)**2 vectors (840 million) take a larger sample.
SAMPLE = 8192
SUBSPACES, CODES = 16, 64
#: Rows of a task's block: members of a list, and vectors that probe it.
MEMBERS, PROBES = 1024, 8192


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)


class Index:
    """Centroids of the inverted lists, and the codebooks of residuals by subspace.

    A vector y of list c is stored as c plus one code word a subspace, with the
    length ``err`` of what that leaves out.  For a vector x the table-lookup
    distance to the stored form is at most the true distance plus err, so the
    filter ``lookup <= radius + err`` loses no pair within the radius.
    """

    def __init__(self, x: np.ndarray, lists: int, dim: int, radius: float):
        self.radius = radius
        if len(x) == 0:
            x = np.zeros((1, dim))
        self.c = _kmeans(x, lists)
        self.cuts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        rest = x - self.c[_nearest(x, self.c)]
        self.books = [_kmeans(rest[:, s], CODES, 5) for s in self.cuts]
        #: A pair's difference is spread over all directions: along the normal of a
        #: border between lists it has a share of 1/sqrt(dim), and four such shares
        #: are passed once in some ten thousand pairs.  One end of the pair is within
        #: half of that from the border.
        self.margin = radius / 2 * min(1.0, 4 / np.sqrt(dim))

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and a matrix of the lists it probes: those whose
        border with its own is nearer than the margin."""
        d = (x**2).sum(1)[:, None] + (self.c**2).sum(1) - 2 * x @ self.c.T
        own = np.argmin(d, axis=1)
        between = np.sqrt(np.maximum(((self.c[:, None, :] - self.c[None, :, :]) ** 2).sum(2), 1e-18)) if len(self.c) <= 512 else None
        gap = between[own] if between is not None else np.stack([np.sqrt(np.maximum(((self.c - self.c[o]) ** 2).sum(1), 1e-18)) for o in own])
        return own, (d - d[np.arange(len(x)), own][:, None]) / (2 * gap) <= self.margin

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = x - self.c[own]
        codes = np.stack([_nearest(rest[:, s], b) for s, b in zip(self.cuts, self.books, strict=True)], axis=1)
        err = np.zeros(len(x))
        for m, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            err += ((rest[:, s] - b[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(err)

    def lookups(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors to stored ones of list ``at``, by one table a subspace."""
        rest, out = x - self.c[at], np.zeros((len(x), len(codes)))
        for m, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = ((rest[:, s][:, None, :] - b[None, :, :]) ** 2).sum(2)
            out += table[:, codes[:, m]]
        return np.sqrt(out)


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _placed(reps: DataFrame, models) -> DataFrame:
    """A row for each vector's own list (member) and one for each list it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                index = models.value.get(int(dim)) or Index(np.empty((0, int(dim))), 1, int(dim), models.value["radius"])
                x = _matrix(part.column("v"), int(dim))
                x = x / np.sqrt((x**2).sum(1))[:, None]
                own, probe = index.probes(x)
                i, lists = np.nonzero(probe)
                take = np.concatenate((np.arange(len(x)), i))
                kind = np.concatenate((np.zeros(len(x), bool), np.ones(len(i), bool)))
                rows = part.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate((own, lists)).astype(np.int32)), pa.array(kind)], names=[*rows.schema.names, "list", "probe"])

    schema = "label string, dim int, rep long, n long, v array<double>, list int, probe boolean"
    return reps.select("label", "dim", "rep", "n", "v").mapInArrow(run, schema)


def _joined(t: pa.Table, models, least: float) -> pa.Table:
    """Links found in one block: what each vector gains, and a spanning set of links."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "gain": pa.array([], pa.int64())})
    dim, at = t["dim"][0].as_py(), t["list"][0].as_py()
    probe = t["probe"].to_numpy()
    if probe.all() or not probe.any():
        return none
    index = models.value.get(dim) or Index(np.empty((0, dim)), 1, dim, models.value["radius"])
    rep, n, raw = t["rep"].to_numpy(), t["n"].to_numpy(), _matrix(t["v"], dim)
    norm = np.sqrt((raw**2).sum(1))
    unit = raw / norm[:, None]
    p, m = np.flatnonzero(probe), np.flatnonzero(~probe)
    own, back = index.probes(unit[m])
    codes, err = index.encode(unit[m], own)
    home, _ = index.probes(unit[p])
    a, b = [], []
    for start in range(0, len(p), 512):
        q = p[start : start + 512]
        i, j = np.nonzero(index.lookups(unit[q], at, codes) <= index.radius + err + 1e-9)
        # a pair that both ends find is the one of the end with the smaller id
        both = back[j, home[start : start + 512][i]]
        keep = (rep[q][i] != rep[m][j]) & (~both | (rep[q][i] < rep[m][j]))
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 65536):
            x, y = q[i[k : k + 65536]], m[j[k : k + 65536]]
            near = (raw[x] * raw[y]).sum(1) / (norm[x] * norm[y]) >= least
            a.append(x[near])
            b.append(y[near])
    if not a:
        return none
    a, b = np.concatenate(a), np.concatenate(b)
    gain = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
    # rows of one vector are one node
    ids, node = np.unique(rep, return_inverse=True)
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, node[a], low[node[b]])
        np.minimum.at(new, node[b], low[node[a]])
        new = new[new]
        if (new == low).all():
            break
        low = new
    total = np.bincount(node, gain, len(ids)).astype(np.int64)
    some = np.flatnonzero(total > 0)
    return pa.table({"a": ids[some], "b": ids[low[some]], "gain": total[some]})


@shielded
def similar_vectors(vectors: DataFrame, least: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) with n_links, component_id and kept.

    Two rows of one label are linked when the cosine of their embeddings, in
    double precision, is ``least`` or more; component_id is the least vec_id that
    links reach, kept whether it is the row's own.  Equal embeddings are one
    vector with a count, so copies are never paired with each other.

    Rows with a null id, a null label, a null, empty or zero embedding or one
    that holds a null or non-finite component link with nothing, nor do
    embeddings of different lengths; labels may be of any simple type; rows with
    equal ids count each; an empty table gives an empty one.  Columns
    that bear an output's name are replaced.  Ids that aren't integers raise a TypeError.
    """
    require_integers(vectors, "vec_id")
    spark = vectors.sparkSession
    base = without(vectors, "n_links", "component_id", "kept").withColumn("__v", F.col("embedding").cast("array<double>"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("__v") > 0)
    usable &= F.forall("__v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("__v", lambda e: e != 0)
    base = base.withColumn("__ok", F.coalesce(usable, F.lit(False)))
    base = base.withColumn("__x", F.xxhash64("label", "__v")).withColumn("__y", F.xxhash64(F.lit(1), "label", "__v"))
    reps = base.where("__ok").groupBy(F.col("__x").alias("x"), F.col("__y").alias("y")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").cast("string").alias("label"), F.first("__v").alias("v"))
    reps = staged(reps.withColumn("dim", F.size("v")), "vectors")
    count = reps.count()
    # a bounded sample, the same on every run
    seen = [r["v"] for r in reps.select("v", "rep").orderBy(F.xxhash64("rep")).limit(sample).select("v").collect()]
    lists = int(np.clip(np.sqrt(count / 50), 1, sample // 2))
    radius = float(np.sqrt(2 - 2 * least))
    models: dict = {"radius": radius}
    for dim in sorted({len(v) for v in seen}):
        x = np.array([v for v in seen if len(v) == dim])
        models[dim] = Index(x / np.sqrt((x**2).sum(1))[:, None], lists, dim, radius)
    shared = spark.sparkContext.broadcast(models)
    placed = staged(_placed(reps, shared), "lists")
    key = ["label", "dim", "list"]
    blocks = placed.groupBy(*key).agg(F.ceil(F.count_if(~F.col("probe")) / MEMBERS).cast("int").alias("mb"), F.ceil(F.count_if("probe") / PROBES).cast("int").alias("pb")).where("mb > 0 and pb > 0")
    cut = placed.join(blocks, key)
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("probe"), F.col("pb")).otherwise(F.col("mb"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("mb")).otherwise(F.col("pb")) - 1))
    cut = cut.withColumn("mine", mine).withColumn("other", every)
    cut = cut.withColumn("i", F.when(F.col("probe"), F.col("other")).otherwise(F.col("mine"))).withColumn("j", F.when(F.col("probe"), F.col("mine")).otherwise(F.col("other")))
    found = staged(cut.drop("mb", "pb", "mine", "other").groupBy(*key, "i", "j").applyInArrow(lambda t: _joined(t, shared, least), "a long, b long, gain long"), "found")
    gains = found.groupBy(F.col("a").alias("rep")).agg(F.sum("gain").alias("gain"))
    comp = connected_components(found.select("a", "b"), "vec").withColumnRenamed("node", "rep")
    known = reps.select("x", "y", "rep", "n").join(gains, "rep", "left").join(comp, "rep", "left")
    known = known.select(F.col("x").alias("__i"), F.col("y").alias("__j"), (F.coalesce("gain", F.lit(0)) + F.col("n") - 1).alias("__links"), F.coalesce("component", "rep").alias("__comp"))
    out = base.join(known, F.col("__ok") & (base["__x"] == known["__i"]) & (base["__y"] == known["__j"]), "left")
    out = out.withColumn("n_links", F.coalesce("__links", F.lit(0)).cast("long")).withColumn("component_id", F.coalesce("__comp", "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).drop("__v", "__ok", "__x", "__y", "__i", "__j", "__links", "__comp")
