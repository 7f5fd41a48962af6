"""Substring deduplication (operator 8) with a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, chunks, clean, discard, gram_hashes, partitions, remove, require_integers, shielded, stage_path, staged, without, word_hashes

#: Words of a window.
WINDOW = 13
#: Bytes of text that are fingerprinted together, and for each slice of fingerprints.
PIECE, SLICE = 4 << 20, 4 << 20
#: The id that stands for a missing one: later than all.
LAST = np.iinfo(np.int64).max
ROW = "piece long, doc_id long, x long, text string"


def pack(values: np.ndarray) -> bytes:
    """Ascending uint64 or any int64 numbers as the planes of their differences' bytes:
    planes of zeros, which most are, take no room once compressed."""
    v = values.view(np.uint64)
    return np.diff(v, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _plain(values: np.ndarray) -> bytes:
    """Numbers in any order, as the planes of their bytes."""
    return values.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplain(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _least(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order with the least id of each."""
    order = np.argsort(h, kind="stable")
    h, first = h[order], first[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    return h[at], np.minimum.reduceat(first, at) if len(at) else first


def _windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, row, first word) of all windows of all texts."""
    words, doc = word_hashes(texts)
    h, at = gram_hashes(words, doc, window)
    row = doc[at]
    return h, row, at - np.searchsorted(doc, row)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, x, text) in pieces of about PIECE bytes of text, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, size = uuid.uuid4().int >> 65, 0
        for whole in batches:
            for batch, texts in chunks(whole, "text"):
                if size > PIECE:
                    piece, size = uuid.uuid4().int >> 65, 0
                size += sum(map(len, texts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), piece, np.int64)), *batch.columns], names=["piece", *batch.schema.names])

    return staged(docs.select("doc_id", "x", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ROW), "pieces")


class FingerprintIndex:
    """Sorted, immutable runs of the window hashes of earlier batches.

    A run holds, for each slice of the hashes' range, the distinct hashes in order
    and the least id of a document that has each.  A new batch's hashes are merged
    with the runs slice by slice, which gives what the batch repeats and the batch's
    own run in one pass.  When FAN_IN runs of a level have gathered they are
    compacted into one of the next level, so a batch meets a number of runs that
    grows with the logarithm of the number of batches.

    A run is a table bucketed by slice.  The largest is merged where it lies; the
    batch, and the smaller runs with it, are moved to it.

    ``bits`` sets the number of slices; one slice of all that the index is to hold
    must fit a task.  Fingerprints have 64 bits; whoever removes anything verifies
    the words (:func:`verified`).

    With a ``path`` the index outlives the session: runs lie there, and a manifest, written
    after each batch, says which count; :meth:`open` takes it up again, and what an
    interrupted batch left is deleted then.  Runs are external tables of the database
    DATABASE, which nothing else is in.
    """

    FAN_IN = 2
    RUN = "slice long, h binary, first binary"
    DATABASE = "finsift_runs"

    def __init__(self, spark: SparkSession, bits: int = 6, window: int = WINDOW, path: str | None = None):
        self.spark, self.bits, self.window, self.path, self.levels = spark, bits, window, path and path.rstrip("/"), []
        self.buckets, self.batches, self.gone = partitions(spark), 0, []
        spark.sql(f"create database if not exists {self.DATABASE}")
        if path and self._listed():
            raise ValueError(f"{path} isn't empty: open it")
        if path:
            self._save()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index at ``path`` as its last whole batch left it."""
        self = cls.__new__(cls)
        self.spark, self.path, self.gone = spark, path.rstrip("/"), []
        spark.sql(f"create database if not exists {cls.DATABASE}")
        listed = self._listed()
        newest = max((n for n in listed if n.startswith("manifest-")), default=None)
        if newest is None:
            raise ValueError(f"{path} holds no index")
        held = json.loads(spark.read.text(f"{self.path}/{newest}", wholetext=True).first()["value"])
        self.bits, self.window, self.buckets, self.batches, self.levels = (held[k] for k in ("bits", "window", "buckets", "batches", "levels"))
        runs = {run for level in self.levels for run in level}
        for name in listed:
            if name.startswith("run_") and f"{cls.DATABASE}.{name}" not in runs:
                spark.sql(f"drop table if exists {cls.DATABASE}.{name}")
                remove(spark, f"{self.path}/{name}")
            elif name.startswith("manifest-") and name != newest or name.startswith("_"):
                remove(spark, f"{self.path}/{name}")
        for run in runs:
            if not spark.catalog.tableExists(run):
                at = f"{self.path}/{run.rpartition('.')[2]}"
                told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(at).schema)
                spark.sql(f"create table {run} ({told}) using parquet clustered by (slice) into {self.buckets} buckets location '{at}'")
        return self

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _listed(self) -> list[str]:
        fs, where = self._files(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _save(self) -> None:
        """Write the manifest in one step; only then delete the runs that were merged."""
        if self.path:
            old = [n for n in self._listed() if n.startswith("manifest-")]
            text = json.dumps({k: getattr(self, k) for k in ("bits", "window", "buckets", "batches", "levels")})
            fs, temporary = self._files(f"{self.path}/_manifest")
            out = fs.create(temporary, True)
            out.write(bytearray(text.encode()))
            out.close()
            number = 1 + max((int(n[9:-5]) for n in old), default=0)
            fs.rename(temporary, self._files(f"{self.path}/manifest-{number:09d}.json")[1])
            for n in old:
                remove(self.spark, f"{self.path}/{n}")
        gone, self.gone = self.gone, []
        self._drop(*gone)

    def _write(self, rows: DataFrame) -> str:
        """A run of rows that are already together by slice."""
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.path}/{name}" if self.path else stage_path(self.spark, "run")
        if not self.path:
            remove(self.spark, path)
        rows.write.bucketBy(self.buckets, "slice").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(f"{self.DATABASE}.{name}")
        return f"{self.DATABASE}.{name}"

    def _drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sql(f"describe formatted {name}").where("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"drop table {name}")
            remove(self.spark, path)
        clean(self.spark)

    def _emitted(self, pieces: DataFrame) -> DataFrame:
        """(slice, piece, h, first): the distinct hashes of each piece, once each."""
        window, bits = self.window, self.bits

        def emit(piece: int, held: list) -> pa.RecordBatch:
            h, first = _least(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            cuts = np.searchsorted(h >> np.uint64(63 - bits) >> np.uint64(1), np.arange((1 << bits) + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array(np.full(len(some), piece, np.int64)), pa.array([pack(h[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()), pa.array([_plain(first[cuts[i] : cuts[i + 1]]) for i in some], pa.binary())],
                names=["slice", "piece", "h", "first"],
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, piece = [], None
            for whole in batches:
                mine = whole.column("piece").to_numpy()
                cuts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1], [True]))) if len(mine) else ()
                for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                    if held and piece != mine[start]:
                        yield emit(piece, held)
                        held = []
                    piece = int(mine[start])
                    for batch, texts in chunks(whole.slice(start, end - start), "text"):
                        h, row, _ = _windows(texts, window)
                        held.append((h, _ids(batch)[row]))
            if held:
                yield emit(piece, held)

        return pieces.mapInArrow(run, "slice long, piece long, h binary, first binary")

    def add(self, pieces: DataFrame, use, keep: bool = True) -> DataFrame:
        """Add a batch, in pieces; returns what ``use`` makes, and writes, of its finds.

        Finds are (piece, h, first): the hashes of each piece of which a smaller id
        than the piece has is in the batch or in history, with that id.  Pieces
        without any are left out.  ``keep`` false makes no run of a batch that none
        will follow.
        """
        # levels hold one run each between batches: the last one's is the largest
        runs = [name for level in self.levels for name in level]
        sent = self._emitted(pieces)
        for name in runs[:-1]:
            sent = sent.unionByName(self.rows(name).select("slice", F.lit(None).cast("long").alias("piece"), "h", "first"))
        last = self.rows(runs[-1]) if runs else self.spark.createDataFrame([], self.RUN)

        def merge(t: pa.Table, large: pa.Table) -> pa.Table:
            old = [x is None for x in t["piece"].to_pylist()]
            hs, firsts = [unpack(x) for x in t["h"].to_pylist()], [_unplain(x) for x in t["first"].to_pylist()]
            history = [(hs[i], firsts[i]) for i in range(len(hs)) if old[i]] + [(unpack(h), _unplain(f)) for h, f in zip(large["h"].to_pylist(), large["first"].to_pylist(), strict=True)]
            own = [i for i in range(len(hs)) if not old[i]]
            out = []
            if own:
                h, first = _least(np.concatenate([hs[i] for i in own]), np.concatenate([firsts[i] for i in own]))
                if keep:
                    out.append((None, h, first))
                best = first.copy()
                for x, f in history:
                    at = np.minimum(np.searchsorted(x, h), len(x) - 1)
                    best = np.where(x[at] == h, np.minimum(best, f[at]), best)
                for i in own:
                    found = best[np.searchsorted(h, hs[i])]
                    more = found < firsts[i]
                    if more.any():
                        out.append((t["piece"][i].as_py(), hs[i][more], found[more]))
            number = t["slice"][0].as_py() if len(t) else None
            return pa.table({"slice": pa.array([number] * len(out), pa.int64()), "piece": pa.array([x[0] for x in out], pa.int64()), "h": pa.array([pack(x[1]) for x in out], pa.binary()), "first": pa.array([_plain(x[2]) for x in out], pa.binary())})

        both = self._write(sent.groupBy("slice").cogroup(last.groupBy("slice")).applyInArrow(merge, "slice long, piece long, h binary, first binary"))
        clean(self.spark)
        out = use(self.spark.table(both).where("piece is not null").select("piece", "h", "first"))
        if not keep:
            self._drop(both)
            return out
        # the run keeps the table of both; compaction leaves the other rows behind
        self._push(both, 0)
        self.batches += 1
        self._save()
        return out

    def _push(self, run: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.FAN_IN:
            return

        def merge(t: pa.Table, other: pa.Table) -> pa.Table:
            both = [t, other]
            h, first = _least(np.concatenate([unpack(x) for y in both for x in y["h"].to_pylist()]), np.concatenate([_unplain(x) for y in both for x in y["first"].to_pylist()]))
            number = next(y["slice"][0].as_py() for y in both if len(y))
            return pa.table({"slice": pa.array([number], pa.int64()), "h": pa.array([pack(h)], pa.binary()), "first": pa.array([_plain(first)], pa.binary())})

        # two runs of a level are merged where they lie
        runs, self.levels[level] = self.levels[level], []
        left, right = (self.rows(r).groupBy("slice") for r in runs)
        merged = self._write(left.cogroup(right).applyInArrow(merge, self.RUN))
        self.gone += runs
        if not self.path:  # nobody opens it again, so room is made at once
            self._save()
        self._push(merged, level + 1)

    def rows(self, run: str) -> DataFrame:
        """(slice, h, first) of a run."""
        table = self.spark.table(run)
        return (table.where("piece is null") if "piece" in table.columns else table).select("slice", "h", "first")

    def drop(self) -> None:
        """Delete all runs, and the folder of an index that has one."""
        self._drop(*[run for level in self.levels for run in level], *self.gone)
        self.levels, self.gone = [], []
        if self.path:
            remove(self.spark, self.path)


def _claims(pieces: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """(doc_id, x, first, at, n, said): the runs of windows of a row that the index
    finds in one earlier document ``first``: first window, their number, and the
    words they cover, joined by single spaces."""

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        parts = [p for whole in t.combine_chunks().to_batches() for p in chunks(whole, "text")]
        windows = [(*_windows(texts, window), _ids(batch)) for batch, texts in parts]
        have, first = _least(np.concatenate([w[0] for w in windows]), np.concatenate([w[3][w[1]] for w in windows]))
        for h, f in zip(found["h"].to_pylist(), found["first"].to_pylist(), strict=True):
            first[np.searchsorted(have, unpack(h))] = _unplain(f)
        out = []
        for (batch, texts), (h, row, at, ids) in zip(parts, windows, strict=True):
            least = first[np.searchsorted(have, h)]
            hit = np.flatnonzero(least < ids[row])
            r, a, f = row[hit], at[hit], least[hit]
            if not len(hit):
                continue
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (f[1:] != f[:-1]) | (a[1:] != a[:-1] + 1)))
            starts = np.flatnonzero(new)
            n = np.diff(np.concatenate((starts, [len(hit)])))
            split, said, last = None, [], -1
            for k, size in zip(starts.tolist(), n.tolist(), strict=True):
                if r[k] != last:
                    last, split = r[k], texts[r[k]].split()
                said.append(b" ".join(split[a[k] : a[k] + size + window - 1]))
            rows = pa.array(r[starts])
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("x").take(rows), pa.array(f[starts]), pa.array(a[starts]), pa.array(n), pa.array(said, pa.binary()).cast(pa.string())], names=names))
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    names = ["doc_id", "x", "first", "at", "n", "said"]
    schema = pa.schema([(c, pa.string() if c == "said" else pa.int64()) for c in names])
    return pieces.groupBy("piece").cogroup(hits.groupBy("piece")).applyInArrow(run, "doc_id long, x long, first long, at long, n long, said string")


def _normal(text: Column) -> Column:
    """Words joined by single spaces, with one before and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " ")), F.lit(" "))


def verified(claims: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows (doc_id, x, at, n) of ``claims`` whose words really stand in the
    document ``first`` of ``docs`` (doc_id, text), compared word by word.

    A run of windows is looked for as a whole; one that is not there in one piece
    (its windows may stand in different places) is looked for window by window.
    """
    wanted = claims.select(F.col("first").alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    texts = staged(texts.select(F.col("doc_id").alias("__first"), _normal(F.col("text")).alias("__held")), "held")
    holds = (F.col("first") == F.col("__first")) & F.contains(F.col("__held"), F.concat(F.lit(" "), F.col("said"), F.lit(" ")))
    whole = staged(claims.join(texts, holds, "left_semi").select("doc_id", "x", "first", "at", "n"), "whole")
    out = whole.select("doc_id", "x", "at", "n")
    if whole.count() < claims.count():
        same = [claims[c].eqNullSafe(whole[c]) for c in ("doc_id", "x", "first", "at", "n")]
        rest = claims.join(whole, same, "left_anti").select("doc_id", "x", "first", "at", F.split("said", " ", -1).alias("w"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
        rest = rest.select("doc_id", "x", "first", (F.col("at") + F.col("k")).alias("at"), F.lit(1).cast("long").alias("n"), F.array_join(F.slice("w", F.col("k") + 1, F.lit(window)), " ").alias("said"))
        out = staged(out.unionByName(rest.join(texts, holds, "left_semi").select("doc_id", "x", "at", "n")), "whole")
        discard(whole)
    discard(texts)
    return out


def _found(index: FingerprintIndex, batch: DataFrame, keep: bool = True) -> DataFrame:
    """Add a batch to the index; returns, written down, what it claims to repeat."""
    pieces = _pieces(batch)
    claims = index.add(pieces, lambda hits: staged(_claims(pieces, hits, index.window), "claims"), keep)
    discard(pieces)
    return claims


def _cuts(claims: DataFrame, corpus: DataFrame, window: int) -> DataFrame:
    cuts = verified(claims, corpus, window)
    return staged(cuts.groupBy("doc_id", "x").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("n").cast("int").alias("n"))).alias("cut")), "cuts")


def deduplicate(index: FingerprintIndex, batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, x, cut) of the rows of a new batch that lose words: ``cut`` has the
    (first window, number of windows) found, and verified, in a document of a
    smaller id, of the batch or of what the index holds.  The batch becomes part of
    the index.

    ``batch`` has doc_id, text and x, a hash of the text; ``corpus`` (doc_id, text)
    has the texts of all batches so far, this one's too, and only those that hold a
    find are read from it.  Batches in order of doc_id give the cuts of one batch
    with all; what an earlier batch keeps is not looked at again.
    """
    return _cuts(_found(index, batch), corpus, index.window)


def batches_by_id(docs: DataFrame, batches: int) -> list:
    """Conditions on doc_id that deal ``docs`` into that many batches in its order,
    the last with the null ids; bounds are approximate quantiles."""
    at = [k / batches for k in range(1, batches)]
    cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", at, 0.01))) if at else []
    c = F.col("doc_id")
    edges = [None, *[int(x) for x in cuts], None]
    out = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        cond = F.lit(True) if high is None else c <= high
        cond = cond if low is None else cond & (c > low)
        out.append(F.coalesce(cond, F.lit(high is None)))
    return out


@shielded
def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = 3) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_text and kept_sha256: each text less
    the words covered by a window of ``window`` words that also starts in a
    document with a smaller doc_id.

    Windows are judged on the input.  Words are runs of non-space characters,
    unchanged; the kept ones are joined by one space.  The documents pass through
    a :class:`FingerprintIndex` in ``batches`` by doc_id.

    A null or empty text has no words; a text shorter than a window keeps all;
    a null doc_id counts as later than any other, and rows with equal ids do not
    cut each other; an empty table gives an empty one.  Columns of ``docs`` that
    bear an output's name are replaced.  Ids that aren't integers raise a TypeError.
    """
    require_integers(docs, "doc_id")
    spark = docs.sparkSession
    base = without(docs, "n_words", "n_removed", "kept_text", "kept_sha256")
    named = base.withColumn("__x", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = named.select("doc_id", "text", F.col("__x").alias("x"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = FingerprintIndex(spark, int(max(np.ceil(np.log2(max(1, size / SLICE))), np.log2(partitions(spark)), 0)), window)
    claims, parts = None, batches_by_id(rows, batches)
    try:
        for k, part in enumerate(parts):
            found = _found(index, rows.where(part), k < len(parts) - 1)
            claims = found if claims is None else claims.unionByName(found)
    finally:
        index.drop()
    # all batches are verified in one pass over the texts
    lost = _cuts(claims, rows, window).select(F.col("doc_id").alias("__id"), F.col("x").alias("__y"), F.col("cut").alias("__cut"))
    joined = named.join(lost, named["doc_id"].eqNullSafe(lost["__id"]) & (named["__x"] == lost["__y"]), "left").drop("__x", "__id", "__y")
    names = base.columns
    schema = base.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit(""), "kept_sha256": F.lit("")}).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in parts:
            for batch, texts in chunks(whole_batch, "text"):
                n, gone, kept = [], [], []
                for t, cut in zip(texts, batch.column("__cut"), strict=True):
                    words = t.split()
                    n.append(len(words))
                    if cut.is_valid:
                        at, k = (cut.values.field(c).to_numpy() for c in ("at", "n"))
                        edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + k + window - 1, minlength=len(words) + 1)
                        words = list(compress(words, np.cumsum(edge[: len(words)]) == 0))
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                sums = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)
