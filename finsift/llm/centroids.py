"""Centroid clustering (operator 13): exact k-means on integer vectors, with distances
from the expansion |x|^2 - 2 x.c + |c|^2 in blocked float64 products."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Vectors of a block, and the bound below which float64 holds every integer.
BLOCK, EXACT = 4096, 1 << 53
_LONG = 1 << 63


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for every finite double."""
    return math.floor(scale * x) if abs(x) < EXACT else int(x) * scale


class Centroids:
    """Integer centroids of any size, in order of their numbers."""

    def __init__(self, rows: list[list[int]], scale: int):
        self.rows, self.scale = rows, scale
        self.largest = max((abs(c) for row in rows for c in row), default=0)
        if self.largest < EXACT:
            self.c = np.array(rows, np.float64)
            self.norm = np.array([sum(c * c for c in row) for row in rows], np.float64)

    def __getstate__(self):
        return self.rows, self.scale

    def __setstate__(self, state):
        self.__init__(*state)

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(vectors, cluster, distance) of the blocks of an array of doubles.

        |x|^2, 2 |x.c|, |c|^2 and every partial sum of them are at most
        dims * (max|x| + max|c|)^2.  Where that stays below 2^53 all of them are
        integers that float64 holds, so the products are exact in any order; the
        other vectors are computed in Python's integers.
        """
        for at in range(0, len(x), BLOCK):
            block = x[at : at + BLOCK]
            top = np.abs(block).max(axis=1) * self.scale + 1  # rounding up by far
            bound = block.shape[1] * (top + float(self.largest)) ** 2
            safe = bound < EXACT
            whole_block = np.empty((len(block), block.shape[1]), np.int64 if safe.all() else object)
            cluster, distance = np.empty(len(block), np.int32), np.empty(len(block), np.int64 if safe.all() else object)
            if safe.any():
                v = np.floor(block[safe] * self.scale)
                d = (v * v).sum(axis=1)[:, None] - 2 * (v @ self.c.T) + self.norm
                near = d.argmin(axis=1)  # the smaller number of equal ones
                cluster[safe], distance[safe] = near, d[np.arange(len(v)), near].astype(np.int64)
                whole_block[safe] = v.astype(np.int64)
            for i in np.flatnonzero(~safe):
                v = [whole(float(e), self.scale) for e in block[i]]
                gaps = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in self.rows]
                cluster[i] = min(range(len(gaps)), key=gaps.__getitem__)
                whole_block[i], distance[i] = v, gaps[cluster[i]]
            yield whole_block, cluster, distance


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _add(a: list, b: list) -> list:
    """Sums of (count, inertia, components) of each cluster, in Python's integers."""
    return [(x[0] + y[0], x[1] + y[1], [s + t for s, t in zip(x[2], y[2], strict=True)]) for x, y in zip(a, b, strict=True)]


def _totals(vectors: DataFrame, centroids: Centroids, dims: int) -> list:
    """(count, inertia, components) of each cluster's vectors: a row of sums for each
    partition, put together by treeAggregate, so the driver gets a few rows however
    many partitions there are."""
    k = len(centroids.rows)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # k vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(0, 0, [0] * dims)] * k
        for batch in batches:
            for v, cluster, distance in shared.value.assign(_matrix(batch, dims)):
                part = []
                for j in range(k):
                    of = cluster == j
                    # int64 sums can't overflow: such blocks have components below 2^27
                    part.append((int(of.sum()), sum(distance[of].tolist()), [int(s) for s in v[of].sum(axis=0)] if of.any() else [0] * dims))
                total = _add(total, part)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    zero = [(0, 0, [0] * dims)] * k
    out = vectors.select("v").mapInArrow(run, "sums binary").rdd.treeAggregate(zero, lambda a, row: _add(a, pickle.loads(row[0])), _add, 3)
    shared.unpersist()
    return out


def digest(row: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of each
    vector of ``dims`` components, none of them null, infinite or not a number.

    Components become floor(``scale`` * x).  Centroids begin as the ``k`` vectors whose
    id, as ``salt``:id, has the least SHA-256; ``rounds`` times every vector goes to its
    nearest centroid (the smaller number of equally near ones), and each centroid that
    has vectors becomes the floor of their mean.  All numbers are exact integers.  Rounds
    end early once no centroid moves, for then no later one would.

    Vectors of other lengths, null ones and such with a null or non-finite component
    give no row.  Repeated rows count each; of equal ids the lesser vector begins a
    centroid first, and null ids come last.  With fewer than ``k`` vectors there are as
    many centroids as vectors; an empty table gives an empty one.  Other columns are not
    read.  A distance or sum beyond the range of long is null, its cluster is right.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # size is -1 or null for a null array
    kept = vectors.where((F.size(vector_col) == dims) & finite).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kept = staged(kept, "vectors")
    named = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(named.asc_nulls_last(), "v").limit(k).select(F.col("v").cast("array<double>").alias("v")).collect()
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<decimal(38,0)>"
    if not first:
        discard(kept)
        return vectors.sparkSession.createDataFrame([], schema)
    now = Centroids([[whole(x, scale) for x in row["v"]] for row in first], scale)
    for _ in range(rounds):
        sums = _totals(kept, now, dims)
        new = [[s // n for s in parts] if n else row for (n, _, parts), row in zip(sums, now.rows, strict=True)]
        moved, now = new != now.rows, Centroids(new, scale)
        if not moved:
            break
    inertia = [part[1] for part in _totals(kept, now, dims)]
    long = lambda x: x if x < _LONG else None
    of_cluster, total = [long(i) for i in inertia], long(sum(inertia))
    digests = [digest(row) for row in now.rows]
    shown = pa.array([[c if abs(c) < 10**38 else None for c in row] for row in now.rows], pa.list_(pa.decimal128(38, 0)))
    shared = vectors.sparkSession.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.assign(_matrix(batch, dims)))
            if not found:
                continue
            cluster = pa.array(np.concatenate([c for _, c, _ in found]))
            distance = pa.array([long(d) for _, _, part in found for d in part.tolist()], pa.int64())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), cluster, distance, pa.array(of_cluster, pa.int64()).take(cluster), pa.array([total] * n, pa.int64()), pa.array(digests).take(cluster), shown.take(cluster)],
                names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"],
            )

    return kept.mapInArrow(run, schema)
