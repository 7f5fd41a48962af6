"""Quality scores, collocations and clusters against brute force, held-out rows and odd
input: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing
column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finsift.llm import centroids, collocations, quality

DOCS = "doc_id long, text string, lang string"


# ------------------------------------------------------------------ 11 quality


def junk(rng, kind, ws):
    if kind == 0:
        return " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in ws)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in ws)
    if kind == 2:
        return " | ".join(ws)
    return " ".join([ws[0]] * len(ws))


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    rows, marks = [], []
    for i in range(600):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        good = i % 4 != 0
        text = ". ".join(" ".join(ws[k : k + 9]).capitalize() for k in range(0, len(ws), 9)) + "." if good else junk(rng, rng.randrange(4), ws)
        rows.append((i, text, "en"))
        marks.append((i, int(good)))
    return spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(marks, "doc_id long, quality int"), dict(marks)


def test_quality_is_learned_and_held_out_rows_are_told(spark, graded):
    docs, labels, marks = graded
    rows = quality.quality(docs, labels).withColumn("held", quality.held_out()).collect()
    assert len(rows) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) >= 0.95 * len(held)
    # labels of held-out rows don't matter
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.quality(docs, flipped).collect()}
    assert again == pytest.approx({r["doc_id"]: r["score"] for r in rows}, abs=1e-6)


def plain_numbers(text):
    t = text.encode()
    ws = [w for w in re.split(rb"[\x20\x09-\x0D]+", t) if w]
    c = Counter(ws)
    root = lambda a, b: math.sqrt(a / b) if b else 0.0
    upper = sum(65 <= b <= 90 for b in t)
    letters = upper + sum(97 <= b <= 122 or b >= 128 for b in t)
    pairs = list(zip(ws, ws[1:], strict=False))
    mean = sum(map(len, ws)) / len(ws) if ws else 0
    return {
        "size": math.log1p(len(t)), "words": math.log1p(len(ws)), "upper": root(upper, len(t)), "bar": root(t.count(b"|"), len(t)), "shout": root(t.count(b"!"), len(t)),
        "line": root(t.count(b"\n"), len(t)), "far_upper": root(sum(x.isupper() for x in text if x < "\xff"), letters), "word_length": math.log1p(mean),
        "word_spread": root(math.sqrt(sum((len(w) - mean) ** 2 for w in ws)), math.sqrt(len(ws)) * (1 + mean)), "short": root(sum(len(w) <= 3 for w in ws), len(ws)), "long": root(sum(len(w) > 20 for w in ws), len(ws)),
        "joined": root(sum(not (chr(w[-1]).isascii() and chr(w[-1]).isalnum() or w[-1] >= 128 or chr(w[-1]) in ",.;:?") for w in ws), len(ws)),
        "distinct": root(len(c), len(ws)), "commonest": root(max(c.values(), default=0), len(ws)), "repeated": root(sum(a == b for a, b in pairs), len(ws)),
        "distinct_pairs": root(len(set(pairs)), len(pairs)), "line_words": math.log1p(len(ws) / (1 + t.count(b"\n"))),
    }


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é\n|!#1.,\tÀ\x0c"), max_size=60), min_size=1, max_size=6))
def test_statistics_match_plain_counts(texts):
    got = quality.numbers([t.encode() for t in texts])
    for row, text in zip(got, texts, strict=True):
        want = plain_numbers(text)
        assert {k: row[quality.NAMES.index(k)] for k in want} == pytest.approx(want)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    d = len(quality.NAMES)
    x = rng.standard_normal((40, d))
    m = quality.Model(np.zeros(d), np.ones(d), None, np.zeros(1), np.zeros(1))
    z = m.fourier(x)[:, :-1]
    gaps = ((x[:, None] - x) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-gaps / (2 * d * quality.WIDTH**2))).max() < 0.3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0, 1)), min_size=1, max_size=30))
def test_calibration_never_falls(rows):
    n = np.array([r[0] for r in rows], float)
    good = np.floor(n * [r[1] for r in rows])
    at, height = quality.isotonic(np.arange(len(rows), dtype=float), n, good)
    assert (np.diff(height) >= 0).all() and (np.diff(at) >= 0).all() and 0 < height.min() and height.max() < 1
    # least squares: every pool's mean is that of its rows
    means = good / n
    fitted = np.interp(np.arange(len(rows)), at, height)
    assert all(abs(fitted[i] - means[i]) <= 0.5 + 1e-9 for i in range(len(rows)) if len(rows) == 1)


def test_quality_on_odd_and_empty_input(spark, graded):
    _, labels, _ = graded
    long_text = "word " * 200_000
    rows = [(1, None, None, "mine", 1), (2, "", "en", "mine", 1), (2, "", "en", "mine", 1), (None, "No id here.", "en", "mine", 1), (3, long_text, "en", "mine", 1), (1, "\x00 \t\n", None, None, None)]
    odd = spark.createDataFrame(rows, DOCS + ", score string, stats int").withColumn("__t", F.lit(5))
    out = quality.quality(odd.drop("__t"), labels).collect()
    assert len(out) == 6 and out[0].__fields__ == ["doc_id", "lang", "score", "predicted"]
    assert len({r["score"] for r in out if r["doc_id"] == 2}) == 1 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.quality(odd.limit(0), labels).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    for none in (labels.limit(0), nulls, labels.where("quality = 1")):
        assert len({r["score"] for r in quality.quality(odd, none).collect()}) == 1


# ------------------------------------------------------------- 12 collocations


def plain_collocations(rows, max_n=3, least=10, share=50, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for m in range(1, max_n + 1):
                for i in range(len(ws) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            if any(len(h) > len(g) and n >= least and 100 * n >= share * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, n in f.items()):
                continue
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_collocations_match_plain_counts(spark, monkeypatch, max_n):
    monkeypatch.setattr(collocations, "CHUNK", 3000)
    monkeypatch.setattr(collocations, "ROWS", 100)
    rng = random.Random(max_n)
    # control characters sort before the space; a word makes up a third of all
    vocabulary = ["the"] * 14 + ["a", "ab", "a\x01", "a\x00b", "É", "é", "straße", "X", "x", "\x1f", "中文", "\x08\x07", *(f"w{i}" for i in range(14))]
    rows = []
    for i in range(260):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", "\n", "."]) for w in ws) if i % 50 else None, [None, "en", "e\tn\x0b", "und", ""][i % 5]))
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    want = plain_collocations([(t, x) for _, t, x in rows], max_n=max_n)
    assert len(want) > 40 and as_rows(collocations.collocations(df, max_n=max_n)) == want
    few = plain_collocations([(t, x) for _, t, x in rows], max_n=max_n, least=3, share=80, top=5)
    assert as_rows(collocations.collocations(df, max_n=max_n, least=3, share=80, top=5)) == few


def test_frequent_words_are_dealt_over_tasks(spark):
    rows = [(i, " ".join(f"hot x{(7 * i + j) % 90}" for j in range(60)), "en") for i in range(80)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    totals = {(r["lang"], r["word"]): r["n"] for r in collocations.word_totals(df, 16).collect()}
    assert totals["en", None] == 80 * 120 and totals["en", "hot"] == 80 * 60
    assert as_rows(collocations.collocations(df)) == plain_collocations([(t, x) for _, t, x in rows])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "c\x0b1"]), min_size=1, max_size=3), min_size=1, max_size=40), st.integers(1, 9))
def test_stack_counts_prefixes(suffixes, batch):
    keys = sorted(("en\t" + "".join(w + "\t" for w in s) for s in suffixes), reverse=True)
    stack, got = collocations.Stack(3, 1), Counter()
    closed = []
    for i in range(0, len(keys), batch):
        part = keys[i : i + batch]
        closed += stack.push(pa.array(part), np.ones(len(part), np.int64), np.ones(len(part), np.int32))
    for prefixes, _, n, _ in closed + stack.close():
        for p, c in zip(prefixes, n.tolist(), strict=True):
            assert p not in got  # closed once
            got[p] = c
    assert got == Counter(("en\t" + "".join(w + "\t" for w in s[:k])).encode() for s in suffixes for k in range(1, len(s) + 1))


def test_large_products_are_exact(spark):
    top, bottom = collocations._floor_div("a * a * 1000000", "l * r"), 10**15 - 1
    row = spark.createDataFrame([(bottom, bottom, 10**15)], "a long, l long, r long").select(*[F.col(c).cast("decimal(16,0)").alias(c) for c in "alr"]).select(top.alias("s")).first()
    assert row["s"] == 1_000_000 * bottom * bottom // (bottom * 10**15)


def test_collocations_on_odd_and_empty_input(spark):
    long_text = "very long text " * 30_000
    rows = [(None, long_text, "en", "mine", 1), (1, None, None, "mine", 1), (1, "", "en", "mine", 1), (2, " \t\n.,", "xx", "mine", 1)]
    df = spark.createDataFrame(rows, DOCS + ", key string, rank int").withColumn("__t", F.lit(1))
    assert as_rows(collocations.collocations(df)) == plain_collocations([(t, x) for _, t, x, *_ in rows])
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("text is null")).count() == 0


# ---------------------------------------------------------------- 13 centroids


def plain_clusters(rows, k, rounds, scale, dims):
    def floor(x):
        return math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale

    kept = [(i, [floor(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    gap = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (gap(v, c[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        c = [[sum(x) // len(of) for x in zip(*of, strict=True)] if (of := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else c[j] for j in range(len(c))]
    found = [(i, j := near(v), gap(v, c[j])) for i, v in kept]
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, j, long(d), long(sum(e for _, o, e in found if o == j)), long(sum(e for *_, e in found)), centroids.digest(c[j])) for i, j, d in found), key=str)


def clusters(df, **kw):
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **kw).drop("centroid").collect()), key=str)


@pytest.mark.parametrize("size", [1.0, 3e4, 1e9, 1e300])
def test_clusters_match_integers_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(centroids, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(3 * (i % 4), 1) * (size if i % 3 else 1.0) for _ in range(5)]) for i in range(90)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (200, rows[4][1]), (None, rows[5][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert clusters(df, k=6, rounds=4, dims=5) == plain_clusters(rows, 6, 4, 1024, 5)


def test_clusters_of_odd_and_empty_input(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", [0.5, -0.5], 1), ("b", [0.5, -0.5], 1), ("c", None, 1), ("d", [], 1), ("e", [1.0], 1), ("f", [None, 1.0], 1), ("g", [nan, 1.0], 1), ("h", [inf, 1.0], 1), ("i", [1.0, 2.0, 3.0], 1), (None, [-1e-9, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, cluster int").withColumns({"id": F.lit(1), "v": F.lit(2)})
    got = clusters(df, dims=2)
    plain = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows]
    assert got == plain_clusters(plain, 8, 10, 1024, 2) and len(got) == 3
    assert centroids.cluster_vectors(df.limit(0)).count() == 0
    assert clusters(df.where("vec_id = 'd'"), dims=2) == []


def test_guard_holds_at_its_bound():
    # components just within and beyond the bound, where a float product would round
    edge = int(math.sqrt((1 << 53) / 2)) // 2
    rows = [[float(edge - 2), float(edge - 3)], [float(edge + 5), float(edge + 4)], [float(2**40 + 1), float(2**40 - 1)]]
    c = [[edge - 3, -edge + 4], [2**40, -(2**40)], [3, 5]]
    for some in (c[:1] + c[2:], c):
        for v, cluster, distance in centroids.Centroids(some, 1).assign(np.array(rows)):
            want = [[sum((int(a) - b) ** 2 for a, b in zip(r, w, strict=True)) for w in some] for r in rows]
            assert distance.tolist() == [min(w) for w in want] and cluster.tolist() == [w.index(min(w)) for w in want]
            assert v.tolist() == [[int(x) for x in r] for r in rows]
