"""The training-data operators against brute force, and on odd input: nulls in any
column, empty and very long texts, ties, repeated rows, empty tables and extra
columns whose names clash with outputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finsift.llm import common, decontam, embed_dedup, line_dedup, minhash, mixing, pii, sharding, substring_index, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "shard", "slot", "text_crc32", "kept", "class_id", "score", "predicted", "n_words", "n_removed", "removed", "x", "y", "n_tokens", "copies", "node", "p", "u", "__size", "__copies", "__tie", "__x", "__v", "__id", "__words", "__row", "__t", "__cut"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if sources is None else sources[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    long_text = words(rng, 20_000) + " " + "9" * 30_000 + "\n" + "é" * 20_000
    rows = [
        (1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "", 0),
        (None, "null id here", "en", "s", 1), (None, "null id here", "en", "s", 1), (4, " \t\n ", "en", "t", 1), (5, long_text, "en", "t", 1),
        (6, long_text, "fr", "t", 1), (1, "same id but another text", "en", "s", 1), (7, "x", "de", "s", None),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------- 1 mixing


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        fair = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if fair[s] > most * sizes[s]}
        if not over:
            return out | fair
        out |= {s: most * sizes[s] for s in over}
        left, open_ = left - sum(most * sizes[s] for s in over), open_ - over
    return out


@pytest.mark.parametrize("sizes", [{"b": 1000, None: 10, "a": 10}, {f"s{i}": 7**(i % 6) for i in range(40)}, {"a": 0, "B": 3, "é": 500, "\U0001f600": 2, "\uff5e": 9}, {"only": 5}, {"a": 0, "b": 0}])
def test_targets_stop_at_three_times_and_share_the_rest(spark, sizes):
    df = spark.createDataFrame([*sizes.items()], "source string, source_size long").repartition(3)
    got = {r["source"]: (r["number"], r["target"]) for r in mixing.targets(df, (5.0, 2.0, 1.0)).collect()}
    want = plain_targets(sizes)
    assert {s: t for s, (_, t) in got.items()} == pytest.approx(want)
    assert sorted(got, key=lambda s: got[s][0]) == sorted(sizes, key=lambda s: (s is None, (s or "").encode()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1000), st.floats(0, 1)), min_size=1, max_size=40), st.integers(0, 1 << 30))
def test_pairs_keep_words_and_leave_one_residual(units, seed):
    size, p = np.array([u[0] for u in units]), np.array([u[1] for u in units])
    out = mixing.pivotal_pairs(size, p, np.random.default_rng(seed).random(len(size)))
    assert abs((size * out).sum() - (size * p).sum()) < 1e-6 * size.sum() + 1e-6
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1 and out.min() >= -1e-9 and out.max() <= 1 + 1e-9


def test_rounding_keeps_expectations():
    size, rng = np.array([50, 30, 20, 7, 3, 1]), np.random.default_rng(1)
    p = np.array([0.2, 0.7, 0.5, 0.9, 0.4, 0.6])
    pairs = np.mean([mixing.pivotal_pairs(size, p, rng.random(6)) for _ in range(4000)], axis=0)
    assert np.abs(pairs - p).max() < 0.04


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    df = docs(spark, [words(rng, rng.randrange(1, 120)) for _ in range(1500)], sources=[["a", "b", None][min(2, i // 500)] if i % 2 else "a" for i in range(1500)])
    plan = mixing.mix_plan(df.select("doc_id", "source", mixing.word_count().alias("size")))
    got = plan.toPandas()
    assert got.copies.between(0, 3).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1
    again = mixing.mix_plan(df.repartition(7).select("doc_id", "source", mixing.word_count().alias("size")))
    assert sorted(map(tuple, again.select("doc_id", "copies").collect())) == sorted(zip(got.doc_id.tolist(), got.copies.tolist(), strict=True))
    sizes = {}
    for r in df.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    want = plain_targets(sizes)
    assert {(None if s is None or s != s else s): (g.source_size.iloc[0], pytest.approx(g.target.iloc[0])) for s, g in got.groupby("source", dropna=False)} == {s: (sizes[s], want[s]) for s in sizes}
    ratio = got.target / got.source_size
    assert ((got.copies == np.floor(ratio)) | (got.copies == np.floor(ratio) + 1)).all()
    taken = mixing.mix(df)
    assert taken.columns == df.columns and taken.count() == got.copies.sum()


def test_mix_on_odd_and_empty_input(odd, empty):
    got = mixing.mix(odd)
    assert got.columns == odd.columns and got.where("size <> 'mine'").count() == 0
    assert mixing.mix(empty).count() == 0


# ----------------------------------------------------------------- 2 sharding


def test_shards_are_contiguous_balanced_and_numbered(spark):
    rng = random.Random(3)
    df = docs(spark, [words(rng, rng.randrange(0, 90)) for _ in range(700)]).repartition(9)
    got = sharding.shard(df, 8).toPandas().sort_values("doc_id")
    size = got.text.map(lambda t: len(t.encode()) + 1)
    assert (got["size"] == size).all() and (got.text_crc32 == got.text.map(lambda t: zlib.crc32(t.encode()))).all()
    middle = size.cumsum() - size / 2
    assert (got["shard"] == (middle * 8 // size.sum()).astype(int)).all()
    totals = got.groupby("shard")["size"].sum()
    assert totals.max() - totals.min() <= 2 * size.max()
    assert all(g.slot.tolist() == list(range(len(g))) for _, g in got.groupby("shard"))


def test_shard_on_odd_and_empty_input(odd, empty):
    got = sharding.shard(odd, 3).toPandas()
    assert len(got) == 11 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got[got.doc_id == 2]["size"].tolist() == [1] and got[got.doc_id == 2].text_crc32.isna().all()
    assert sharding.shard(empty, 3).count() == 0


# ---------------------------------------------------------------------- 3 pii

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def base(text):
    out = []
    for k, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if good:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_base_identifiers_match_plain_search(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "a@b._q@c.d", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "++49 30 123456", "é", "日本", "12", "@", "_", " ", "\n", "a", "."]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "_"]) for _ in range(rng.randrange(1, 14))) for _ in range(250)] + [None, "", "1" * 5000, "a" * 5000 + "@", " ".join(["10.0.0.1"] * 600)]
    got = {r["doc_id"]: r for r in pii.private_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(filter(None, got[i]["spans"].split(",")))
        assert [got[i][f"n_{k}"] for k in FORMS] == [sum(w.startswith(k) for w in want) for k in FORMS]


def test_contexts_give_away_unseen_identifiers(spark):
    seeds = [f"please contact us at user{i}@mail.example.com for help" for i in range(12)]
    hidden = ["please contact us at user[at]mail.example.org for help"]
    clean = ["it costs 15,000 at most for help", "room[at]home we met"]
    got = [r["spans"] for r in pii.private_data(docs(spark, seeds + hidden + clean)).orderBy("doc_id").collect()]
    assert got[12] == "email:21:45" and got[13] == "" and got[14] == ""


UNSEEN = {
    "email": (["write to {} for help", "her address is {} at work"], lambda r: r.choice([f"user{r.randrange(10**4)}[at]mail.example.org", f"user{r.randrange(10**4)} at host{r.randrange(99)} dot com", f"u{r.randrange(10**4)}@localhost"])),
    "ip": (["the server {} was slow", "logins from {} were blocked"], lambda r: r.choice([f"fe80::{r.randrange(16**4):x}:{r.randrange(16**4):x}", "-".join(str(r.randrange(256)) for _ in range(4))])),
    "card": (["paid with {} in full", "the number {} has expired"], lambda r: "/".join(f"{r.randrange(10**4):04d}" for _ in range(4))),
    "phone": (["call me on {} after six", "ring {} until noon"], lambda r: r.choice([f"(0{r.randrange(10, 99)}) {r.randrange(10**3, 10**4)} {r.randrange(10**3, 10**4)}", f"0{r.randrange(100, 999)}-{r.randrange(10**5, 10**6)}"])),
}


def luhn_card(r):
    d = [r.randrange(1, 10) for _ in range(15)]
    return "".join(map(str, d)) + next(c for c in "0123456789" if luhn("".join(map(str, d)) + c))


def test_discovery_finds_unseen_forms_and_little_else(spark):
    rng = random.Random(47)
    seed = {"email": lambda: f"user{rng.randrange(10**6)}@mail.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": lambda: luhn_card(rng), "phone": lambda: f"+49 30 {rng.randrange(10**6, 10**7)}"}
    texts, want, base_of = [], set(), set()
    for kind, (contexts, unseen) in UNSEEN.items():
        for c in contexts:
            for _ in range(25):
                texts.append(words(rng, 8) + " " + c.format(seed[kind]()) + " " + words(rng, 5))
            for _ in range(8):
                value, lead = unseen(rng), words(rng, 8) + " "
                at = len(lead) + c.index("{")
                want.add((len(texts), f"{kind}:{at}:{at + len(value)}"))
                texts.append(lead + c.format(value) + " " + words(rng, 5))
    for kind, (_, unseen) in UNSEEN.items():  # the same forms where nothing speaks for them
        texts += [words(rng, 6) + " " + unseen(rng) + " " + words(rng, 6) for _ in range(20)]
    found = set()
    for r in pii.private_data(docs(spark, texts)).collect():
        found |= {(r["doc_id"], x) for x in filter(None, r["spans"].split(","))} - {(r["doc_id"], x) for x in base(texts[r["doc_id"]])}
    recall, precision = len(found & want) / len(want), len(found & want) / max(1, len(found))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, sorted(want - found)[:9], sorted(found - want)[:9])


def test_seeds_are_found_beside_other_numbers(spark):
    cards = ["4111111111111111", "4012888888881881"]
    texts = [f"paid with {cards[0]} today", f"numbers 7536784127813050 {cards[0]} here", cards[1], f"{cards[1]} 7536784127813050", f"7536784127813050 {cards[0]}."]
    got = [r["spans"] for r in pii.private_data(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["card:10:26", "card:25:41", "card:0:16", "card:0:16", "card:17:33"]


def test_private_data_on_odd_and_empty_input(odd, empty):
    assert pii.private_data(odd).count() == 11 and pii.private_data(empty).count() == 0


# ----------------------------------------------------------------- 4 toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=0, max_size=9))
def test_automaton_finds_what_edit_distance_finds(word):
    terms = {"abcab": 1.0, "bca": 1.0, "caabba": 1.0, "aaaaaa": 1.0}
    m = toxicity.Lexicon(terms, {}, set()).match(word)
    best = min(((distance(word, t), t) for t in terms if distance(word, t) <= (1 if len(t) >= toxicity.FUZZY_FROM else 0)), default=None)
    assert (m is None) == (best is None) and (m is None or m[0] == best[0])


def test_stems_exceptions_and_quotation():
    lex = toxicity.Lexicon({"stupid": 3.0}, {"lowei": 2.0}, {"stupids"})
    assert lex.match("loweischaft")[1:] == (1, "lowei") and lex.match("stupd")[0] == 1 and lex.match("stupids") is None and lex.match("stud") is None
    abuse, quoted = toxicity.features("you are stupid", lex), toxicity.features('they wrote "stupid" on it', lex)
    assert abuse[1] > 0 and abuse[2] == 0 and quoted[1] == 0 and quoted[2] > 0


def plain_features(text, lex):
    """The numbers of a text by comparison of each word with each term."""
    quotes, tokens_, open_, sums, top = set("\"«»“”„‘’‹›"), text.lower().split(), False, [0.0] * 4, 0.0
    kept = []
    for t in tokens_:
        marks = sum(c in quotes for c in t)
        if t.strip(toxicity._STRIP):
            kept.append((t.strip(toxicity._STRIP), open_ or marks > 0))
        open_ ^= marks % 2 == 1
    for i, (w, inside) in enumerate(kept):
        near = [(distance(w, t), 0, t) for t in lex.terms if distance(w, t) <= (len(t) >= toxicity.FUZZY_FROM)]
        near += [(0, 1, s) for s in lex.stems if w.startswith(s)]
        if not near or (min(near)[0] and w in lex.clean):
            continue
        edits, stem, t = min(near)
        around = [x for x, _ in kept[max(0, i - 8) : i] + kept[i + 1 : i + 9]] + [w]
        quoted = inside or any(x in lex.reporting for x in around)
        weight = (lex.stems if stem else lex.terms)[t]
        sums[2 * (edits > 0) + quoted] += weight
        if not quoted and not edits:
            top = max(top, weight)
    if not any(sums):
        return [1.0] + [0.0] * 6
    return [1.0, *np.log1p(sums), top, min(1.0, 20 * (sums[0] + sums[2]) / (10 + len(kept)))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["stupid", "stupidd", "\"stupid", "stupid\"", "stupids", "moron!", "mron", "lowei", "loweix", "said", "says,", "«you", "are»", "a", "b", "c", "d", "e", "...", "x" * 50 + "y"]), max_size=40))
def test_features_match_plain_comparison(parts):
    lex = toxicity.Lexicon({"stupid": 3.0, "moron": 2.0, "x" * 50 + "z": 1.0}, {"lowei": 1.5}, {"stupids"}, frozenset({"said", "says"}))
    text = " ".join(parts)
    assert toxicity.features(text, lex).tolist() == pytest.approx(plain_features(text, lex))


def test_long_words_count_whole():
    lex = toxicity.Lexicon({"x" * 40 + "abc": 1.0}, {}, set())
    assert lex.match("x" * 40 + "abd")[0] == 1 and lex.match("x" * 40 + "qrs") is None


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(6)
    texts, toxic = [], []
    for i in range(800):
        bad = i % 5 == 0
        t = words(rng, 40, 3000).split()
        if bad:
            for w in rng.sample(["moronic", "worthless", "pathetic", "vequ" + rng.choice("abcdefgh") + "x"], 2):
                t[rng.randrange(40)] = w
        texts.append(" ".join(t))
        toxic.append(int(bad))
    df = docs(spark, texts)
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = toxicity.score(df.withColumn("score", F.lit("mine")), model).withColumn("held", toxicity.held_out()).toPandas()
    held = got[got.held]
    assert len(held) > 100 and (held.predicted == held.doc_id.map(lambda i: toxic[i])).mean() > 0.98
    assert (got.held == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert model.score("a w1 wirthless thing") > model.score("a w1 thing") and 0 <= model.score("") <= 1


def test_toxicity_learns_all_terms(spark):
    rng = random.Random(16)
    terms = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(5600)})  # more than 5000 qualify
    toxic = [[] for _ in range(340)]
    for t in terms:
        for i in rng.sample(range(340), 12):
            toxic[i].append(t)
    texts = [" ".join(t) for t in toxic] + [" ".join(f"w{rng.randrange(300)}" for _ in range(10)) for _ in range(3000)]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 340)) for i in range(len(texts))], "doc_id long, toxic int")
    trained = {r[0] for r in labels.where(~toxicity.held_out()).collect()}
    often = {t for t in terms if sum(t in set(toxic[i]) for i in trained if i < 340) >= 6}
    model = toxicity.train(table, labels)
    fewer = toxicity.train(table, labels, mined=200)
    assert 0 < len(fewer.lex.terms) < len(model.lex.terms)
    assert len(often) > 5000 and often <= set(model.lex.terms)


def test_toxicity_on_odd_and_empty_input(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    assert toxicity.score(odd, model).where("score between 0 and 1 and predicted = 0").count() == 11
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0


# --------------------------------------------------------------- 5 line dedup


def plain_lines(rows):
    """Lines that go, by comparison of all pairs of lines."""
    every = [(i, k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if re.search(r"[^ \t-\r]", line)]
    first = {}
    for i, k, line in every:
        first.setdefault(line, (i, k))
    gone = {}
    for i, k, line in every:
        near = [first[o] for o in first if o == line or min(len(o), len(line)) >= line_dedup.SHORTEST and abs(len(o) - len(line)) <= 1 and distance(o, line) <= 1]
        if min(near) < (i, k):
            gone.setdefault(i, []).append(k)
    return gone


def test_lines_match_all_pairs(spark):
    rng = random.Random(7)
    stock = ["".join(rng.choice("abé ") for _ in range(rng.randrange(8, 40))) + "z" for _ in range(25)]

    def edited(s):
        p, c = rng.randrange(len(s) + 1), rng.choice("abcé")
        return rng.choice([s, s, s[:p] + c + s[p:], s[:p] + s[p + 1 :], s[:p] + c + s[p + 1 :], edited(s) if rng.random() < 0.3 else s])

    texts = ["\n".join(edited(rng.choice(stock)) for _ in range(rng.randrange(1, 7))) for _ in range(60)] + ["\n\n", None, ""]
    df = docs(spark, texts)
    want = plain_lines(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert {i: list(r["removed"]) for i, r in got.items() if r["removed"]} == want
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, []))
        assert got[i]["kept_text"] == kept and got[i]["n_lines"] == (0 if t is None else len(t.split("\n")))


def test_long_lines_one_edit_apart(spark):
    s = "".join(random.Random(8).choice("abcdefgh") for _ in range(3000))
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(docs(spark, [s, s[:1500] + "X" + s[1500:], s[:-1], s[:10] + "Y" + s[11:], s[:5] + "ab" + s[9:]])).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def test_lines_on_odd_and_empty_input(odd, empty):
    got = line_dedup.line_dedup(odd).toPandas()
    assert len(got) == 11 and got[got.doc_id == 6].n_removed.tolist() == [2]
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("shortest", [2, 5])
def test_short_lines_take_part_if_asked(spark, shortest):
    texts = ["abcd", "abce", "abcde", "ab", "ac", "xyz\nxy", "qqqqq", "qqqqqq"]
    want = {2: {1, 2, 4, 7}, 5: {7}}[shortest] | ({5} if shortest == 2 else set())
    got = line_dedup.line_dedup(docs(spark, texts), shortest=shortest).where("n_removed > 0").collect()
    assert {r["doc_id"] for r in got} == want


# --------------------------------------------------------------- 6 embeddings


def test_vectors_match_all_pairs_and_odd_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[rng.integers(0, 100, 100)] + rng.normal(size=(100, 16)) * 0.25
    x[200:220] = x[0]
    rows = [(i, [float(v) for v in x[i]], int(i % 2) if i < 250 else None) for i in range(300)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (None, [float(v) for v in x[0]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("mine"))
    got = {r["vec_id"]: r for r in embed_dedup.similar_vectors(df).collect()}
    f = x.astype(np.float32).astype(float)
    c = f @ f.T / np.outer(np.linalg.norm(f, axis=1), np.linalg.norm(f, axis=1))
    link = {(i, j) for i in range(250) for j in range(250) if i != j and i % 2 == j % 2 and c[i, j] >= 0.93}
    low = list(range(300))
    for _ in range(300):
        new = [min([low[i]] + [low[j] for j in range(250) if (i, j) in link]) if i < 250 else i for i in range(300)]
        if new == low:
            break
        low = new
    assert len(link) > 300
    for i in range(300):
        assert got[i]["n_links"] == sum((i, j) in link for j in range(250)) and got[i]["component_id"] == low[i] and got[i]["kept"] == (low[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(1000, 1006)) and got[None]["n_links"] == 0
    assert embed_dedup.similar_vectors(df.where("false")).count() == 0
    named = df.where("vec_id < 250").withColumn("label", F.when(F.col("label") == 0, "even").otherwise("odd one"))
    again = {r["vec_id"]: r["n_links"] for r in embed_dedup.similar_vectors(named).collect()}
    assert all(again[i] == got[i]["n_links"] for i in range(250))


# ------------------------------------------------------------ 7 near copies


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(1000 + i, 1001 + i) for i in range(30)] + [(5000, 5000 + i) for i in range(40)]
    low = {n: n for e in edges for n in e}
    for _ in range(len(low)):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in low.items() if n in got} and {n for a, b in edges if a != b for n in (a, b)} == set(got)


def test_near_copies_join_and_others_stay(spark):
    rng = random.Random(11)
    texts, group = [], []
    for g in range(60):
        t = words(rng, 150, 5000).split()
        for _ in range(1 + g % 3):
            u = list(t)
            if rng.random() < 0.7:
                u[rng.randrange(150)] = "changed"
            texts.append(" ".join(u))
            group.append(g)
    shared = words(rng, 60, 5000)
    texts += [shared + " " + words(rng, 200, 5000) for _ in range(20)] + ["short text", "short  text", "short text"]
    group += list(range(100, 120)) + [200, 200, 200]
    got = {r["doc_id"]: r for r in minhash.near_dedup(docs(spark, texts)).collect()}
    want = [group.index(g) for g in group]
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert [got[i]["kept"] for i in range(len(texts))] == [w == i for i, w in enumerate(want)]


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(12)
    h = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    s = minhash.Sampler(600)
    keys = [s(np.array([0]), h, w, 600, 1)[0] for w in (a, b)]
    assert abs((keys[0] == keys[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.08


def hashed(df):
    return df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("y"))


def plain_weights(texts, n=5, rarest=minhash.RAREST):
    """Weighted shingles of each text, by the definition."""
    grams = []
    for t in texts:
        w = (t or "").split()
        s = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
        grams.append({g: s.count(g) for g in s})
    n_docs = sum(bool(g) for g in grams)
    df = {}
    for g in grams:
        for k in g:
            df[k] = df.get(k, 0) + 1
    floor = max(1.0, rarest * n_docs)
    idf = {k: 1 + min(1, max(0, np.log(n_docs / d) / np.log(max(n_docs, 2) / floor))) if d > floor else 2.0 for k, d in df.items()}
    return [{k: c * idf[k] for k, c in g.items()} for g in grams]


def plain_similarity(a, b):
    least = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return least / (sum(a.values()) + sum(b.values()) - least) if a and b else 0.0


@pytest.mark.parametrize("rarest", [minhash.RAREST, 0.05])
def test_document_frequencies_are_exact(spark, monkeypatch, rarest):
    monkeypatch.setattr(minhash, "PIECE", 1 << 12)
    monkeypatch.setattr(minhash, "SLICE", 1 << 14)
    rng = random.Random(17)
    texts = [words(rng, 60, 30) + " " + " ".join(f"w{j}" for j in range(rng.randrange(12))) for _ in range(300)]
    texts += texts[:20] + ["", None, "short one", "short one"]
    unique = minhash.distinct_texts(hashed(docs(spark, texts)).repartition(7))
    weights = minhash.document_weights(unique, 5, rarest)
    for t, want in zip(texts, plain_weights(texts, rarest=rarest), strict=True):
        _, h, times = minhash.shingles([(t or "").encode()], 5)
        assert sorted(times * weights(h)) == pytest.approx(sorted(want.values()))


def test_long_documents_do_not_change_weights(spark):
    rng = random.Random(11)
    shared = words(rng, 20, 9000)

    def corpus(size):  # every fifth document has the shared passage
        return spark.createDataFrame([(i, 1, f"{words(rng, size, 9000)} {shared if i % 5 == 0 else ''}") for i in range(60)], "node long, copies long, text string")

    _, h, _ = minhash.shingles([shared.encode()], 5)
    short, long_ = (minhash.document_weights(corpus(n), 5)(h) for n in (10, 4000))
    assert short == pytest.approx(long_) and 1 < short.max() < 2


def test_blocks_find_all_links():
    rng = random.Random(23)
    base = words(rng, 120, 3000).split()
    texts = []
    for i in range(90):
        u = list(base if i % 3 else words(rng, 100, 40).split())
        for _ in range(rng.randrange(6)):
            u[rng.randrange(100)] = rng.choice(["q", "r", f"z{i}"])
        texts.append(" ".join(u))
    n_docs, weights = 90, minhash.Weights(np.empty(0, np.uint64), np.empty(0), 90, 1.0)
    plain = []
    for t in texts:
        w = t.split()
        s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        plain.append({g: 2.0 * s.count(g) for g in s})
    comp = np.arange(n_docs) // 2
    left, right = [t.encode() for t in texts[:50]], [t.encode() for t in texts[30:]]
    i, j = minhash.block_links(left, right, comp[:50], comp[30:], weights, 0.8, 5)
    want = {(a, b) for a in range(50) for b in range(60) if comp[a] != comp[30 + b] and plain_similarity(plain[a], plain[30 + b]) >= 0.8}
    assert want and set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("block", [7, 512])
def test_near_copies_match_all_pairs(spark, monkeypatch, block):
    """A large group whose pairs lie on both sides of the limit, among other texts."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHARE", 5)
    rng = random.Random(29)
    base, texts = words(rng, 160, 3000).split(), []
    for i in range(130):
        u = list(base)
        for _ in range(rng.randrange(1, 7)):
            u[rng.randrange(160)] = rng.choice(["same", f"other{rng.randrange(9)}", f"own{i}"])
        texts.append(" ".join(u))
    texts += [words(rng, 90, 3000) for _ in range(60)] + [texts[3], texts[3] + " tail", None, "", "two words"]
    w = plain_weights(texts)
    low = list(range(len(texts)))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (texts[a] or "") == (texts[b] or "") or plain_similarity(w[a], w[b]) >= 0.8]
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_dedup(docs(spark, texts)).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 300 and len(set(low[:130])) > 3
    assert all(low[i] == low[c] for i, c in got.items())  # nothing is joined without a link
    assert found >= 0.99 * len(links)


def test_unlike_words_of_one_polynomial_hash_stay_apart(spark):
    flip = lambda s: "".join("b" if c == "a" else "a" for c in s)
    a = "a"
    while len(a) < 1024:
        a += flip(a)
    b = flip(a)
    assert common.word_hashes([a.encode()])[0] != common.word_hashes([b.encode()])[0]
    rest = " ".join(f"w{i}" for i in range(12))
    df = docs(spark, [f"{a} {rest}", f"{b} {rest}"])
    assert [r["n_removed"] for r in substring_index.substring_dedup(df).orderBy("doc_id").collect()] == [0, 0]
    df = docs(spark, [f"{a} x y z", f"{b} x y z"])
    assert [r["class_id"] for r in minhash.near_dedup(df).orderBy("doc_id").collect()] == [0, 1]
    bench = spark.createDataFrame([(1, f"{a} x")], "item_id long, text string")
    assert [r["score"] for r in decontam.find_leaks(df, bench, seed=1, least=0.5).orderBy("doc_id").collect()] == [1.0, 0.5]


def test_texts_without_ids_are_compared(spark):
    rng = random.Random(31)
    t, u = words(rng, 100, 3000), words(rng, 100, 3000)
    df = docs(spark, [t, t + " x", u, u, u + " y", "alone"], ids=[5, None, None, None, None, None])
    got = minhash.near_dedup(df).toPandas()
    assert got.class_id.dropna().tolist() == [5, 5] and got[got.doc_id == 5].kept.all()
    kept = got[got.kept].text
    assert (kept == t).sum() == 1 and kept.isin([u, u + " y"]).any() and kept[kept.isin([u, u + " y"])].nunique() == 1 and (kept == "alone").sum() == 1 and not (kept == t + " x").any()


def test_near_copies_on_odd_and_empty_input(odd, empty):
    got = minhash.near_dedup(odd).toPandas()
    assert len(got) == 11 and got[got.doc_id == 6].kept.tolist() == [False] and got[got.doc_id.isna()].kept.all()
    assert got[got.doc_id == 1].kept.all() and got[got.doc_id == 3].kept.tolist() == [False]
    assert minhash.near_dedup(empty).count() == 0


# -------------------------------------------------------------- 8 substrings


def plain_windows(rows, n):
    out, seen = {}, {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cut = set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if seen.setdefault(key, i) < i:
                cut.update(range(k, k + n))
        out[i] = [x for k, x in enumerate(w) if k not in cut]
    return out


def test_windows_match_plain_search(spark):
    rng = random.Random(13)
    stock = [words(rng, rng.randrange(5, 60), 50) for _ in range(12)]
    texts = [" ".join(rng.choice([rng.choice(stock), words(rng, rng.randrange(1, 30), 50)]) for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    texts += [texts[3], texts[3], None, "", "a\u00a0b\u2003c d"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    got = {r["doc_id"]: r for r in substring_index.substring_dedup(docs(spark, texts, ids=order)).collect()}
    want = plain_windows([(order[i], t) for i, t in enumerate(texts)], 13)
    for i, w in want.items():
        assert got[i]["kept_text"] == " ".join(w) and got[i]["kept_sha256"] == hashlib.sha256(" ".join(w).encode()).hexdigest()
        assert got[i]["n_words"] - got[i]["n_removed"] == len(w)


def test_batches_give_what_one_gives(spark):
    rng = random.Random(19)
    stock = [words(rng, rng.randrange(13, 40), 60) for _ in range(10)]
    texts = [" ".join(rng.choice([rng.choice(stock), words(rng, rng.randrange(1, 20), 60)]) for _ in range(rng.randrange(1, 6))) for _ in range(90)]
    df = hashed(docs(spark, texts)).drop("y").repartition(5)
    index = substring_index.FingerprintIndex(spark, bits=2)
    cut = {}
    for k in range(5):  # history is kept between calls; only finds are read again
        batch = df.where(f"doc_id between {k * 18} and {k * 18 + 17}")
        for r in substring_index.deduplicate(index, batch, df.where(f"doc_id < {k * 18 + 18}")).collect():
            cut[r["doc_id"]] = {p for c in r["cut"] for p in range(c["at"], c["at"] + c["n"] + 12)}
    assert [len(level) for level in index.levels] == [1, 0, 1]
    index.drop()
    want = plain_windows(list(enumerate(texts)), 13)
    assert {i: [w for k, w in enumerate(t.split()) if k not in cut.get(i, ())] for i, t in enumerate(texts)} == want
    for batches in (1, 4):
        got = {r["doc_id"]: r["kept_text"].split() for r in substring_index.substring_dedup(docs(spark, texts), batches=batches).collect()}
        assert got == want


def test_an_index_outlives_its_session(spark, tmp_path):
    rng = random.Random(23)
    stock = [words(rng, rng.randrange(13, 40), 60) for _ in range(6)]
    texts = [" ".join(rng.choice([rng.choice(stock), words(rng, rng.randrange(1, 20), 60)]) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    df, path = hashed(docs(spark, texts)).drop("y").repartition(3), str(tmp_path / "index")
    database, cut = substring_index.FingerprintIndex.DATABASE, {}

    def batch(index, k):
        for r in substring_index.deduplicate(index, df.where(f"doc_id between {k * 20} and {k * 20 + 19}"), df.where(f"doc_id < {k * 20 + 20}")).collect():
            cut[r["doc_id"]] = {p for c in r["cut"] for p in range(c["at"], c["at"] + c["n"] + 12)}

    index = substring_index.FingerprintIndex(spark, bits=2, path=path)
    batch(index, 0)
    with pytest.raises(ValueError, match="open"):
        substring_index.FingerprintIndex(spark, path=path)
    for k in (1, 2):
        # a session that was cut short in a batch, and one that knows none of the tables
        index._write(spark.createDataFrame([], index.RUN))
        (tmp_path / "index" / "_manifest").write_text("half")
        spark.sql(f"drop database {database} cascade")
        index = substring_index.FingerprintIndex.open(spark, path)
        assert index.batches == k and len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("run_")]) == sum(map(len, index.levels))
        batch(index, k)
    assert {i: [w for k, w in enumerate(t.split()) if k not in cut.get(i, ())] for i, t in enumerate(texts)} == plain_windows(list(enumerate(texts)), 13)
    index.drop()
    assert not (tmp_path / "index").exists() and not spark.sql(f"show tables in {database}").count() and not spark.sql("show tables").where("tableName like '%run_%'").count()
    with pytest.raises(ValueError, match="no index"):
        substring_index.FingerprintIndex.open(spark, path)


def test_nothing_and_repeats_in_an_index(spark):
    index = substring_index.FingerprintIndex(spark, bits=1)
    text = words(random.Random(1), 20)
    for k, rows in enumerate(([], [(1, text), (1, text), (None, text), (2, None)], [(3, text), (None, text)], [])):
        df = hashed(spark.createDataFrame(rows, "doc_id long, text string")).drop("y")
        got = [(r["doc_id"], [tuple(c) for c in r["cut"]]) for r in substring_index.deduplicate(index, df, spark.createDataFrame([(1, text), (3, text)], "doc_id long, text string")).collect()]
        assert sorted(got, key=str) == [[], [(None, [(0, 8)])], [(3, [(0, 8)]), (None, [(0, 8)])], []][k]
    index.drop()


def test_ids_must_be_integers_where_they_are_compared(spark):
    rows = spark.createDataFrame([("a", "text", [1.0], 1)], "doc_id string, text string, embedding array<double>, label int")
    for run in (minhash.near_dedup, substring_index.substring_dedup, lambda df: embed_dedup.similar_vectors(df.withColumnRenamed("doc_id", "vec_id"))):
        with pytest.raises(TypeError, match="integer"):
            run(rows)


def test_false_claims_are_refuted(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    corpus = docs(spark, [a + " " + b, "x " + a + " y"])
    claim = lambda at, n, said: (9, 1, 0, at, n, said)
    both = " ".join(b.split()[:13]), " ".join(a.split()[:13])
    rows = [claim(0, 8, a), claim(50, 1, "a0 " * 12 + "a0"), claim(70, 2, both[0] + " " + "a1"), claim(90, 14, both[0] + " " + both[1])]
    claims = spark.createDataFrame(rows, "doc_id long, x long, first long, at long, n long, said string")
    got = sorted((r["at"], r["n"]) for r in substring_index.verified(common.staged(claims, "claims"), corpus).collect())
    assert got == [(0, 8), (70, 1), (90, 1), (103, 1)]


def test_numbers_pack_and_unpack():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        h = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (substring_index.unpack(substring_index.pack(h)) == h).all()
        v = rng.integers(-(1 << 62), 1 << 62, n)
        assert (substring_index._unplain(substring_index._plain(v)) == v).all()


def test_substrings_on_odd_and_empty_input(odd, empty):
    got = substring_index.substring_dedup(odd).toPandas()
    assert len(got) == 11 and got[got.doc_id == 6].kept_text.tolist() == [""] and got[got.doc_id == 5].n_removed.tolist() == [0]
    assert substring_index.substring_dedup(empty).count() == 0


# --------------------------------------------------------- 9 decontamination


def plain_align(a, b):
    best, row = 0, [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for j, x in enumerate(a, 1):
            new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best / len(a)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=12))
def test_alignment_scores(a, b):
    got, x, y = decontam.align(np.array(a), np.array(b))
    assert got == pytest.approx(plain_align(a, b)) and 0 <= x <= y < max(1, len(b))


def test_leaks_whole_and_edited(spark):
    rng = random.Random(14)
    items = [words(rng, 30, 4000) for _ in range(12)]
    edited = items[1].split()
    edited[5], edited[20] = "other", "word"
    del edited[12]
    texts = [words(rng, 80, 4000) for _ in range(60)]
    texts[7] = words(rng, 20) + " " + items[0].upper().replace(" ", ", ") + ". " + words(rng, 20)
    texts[8] = " ".join(edited) + " " + words(rng, 30, 4000)
    texts[9] = " ".join(items[2].split()[:6]) + " " + words(rng, 30, 4000)
    texts += [None, ""]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "two words"), (52, "")], "item_id long, text string")
    found = decontam.find_leaks(docs(spark, texts), bench)
    got = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert set(got) == {(7, 0), (8, 1)} and got[7, 0]["score"] == 1.0 and (got[7, 0]["first_word"], got[7, 0]["last_word"]) == (20, 49)
    clean = decontam.decontaminate(docs(spark, texts), bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(62)) - {7, 8} and clean.columns == docs(spark, texts).columns


def test_leaks_match_all_alignments(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 600)  # several passes
    rng = random.Random(43)
    items = [words(rng, rng.randrange(3, 30), 60) for _ in range(14)]
    texts = []
    for _ in range(70):
        t = words(rng, rng.randrange(5, 60), 60).split()
        u = rng.choice(items).split()
        for _ in range(rng.randrange(0, 8)):
            k = rng.randrange(len(u) + 1)
            u[k : k + rng.randrange(2)] = rng.choice([[], ["q"], ["r", "s"]])
        k = rng.randrange(len(t))
        texts.append(" ".join(t[:k] + u + t[k:]))
    names = [f"item {k}" for k in range(len(items))]
    df = docs(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    found = decontam.find_leaks(df, spark.createDataFrame([*zip(names, items, strict=True)], "item_id string, text string"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()}
    want = {(f"d{i}", names[k]): plain_align(q.split(), t.split()) for i, t in enumerate(texts) for k, q in enumerate(items)}
    want = {k: v for k, v in want.items() if v >= 0.5}
    assert len(want) > 40 and got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    clean = decontam.decontaminate(df, spark.createDataFrame([*zip(names, items, strict=True)], "item_id string, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {f"d{i}" for i in range(70)} - {d for d, _ in want}


def test_leaks_edited_alike_in_many_documents(spark):
    rng = random.Random(15)
    items = [words(rng, 40, 4000) for _ in range(4)]
    edited = items[0].split()
    edited[4::5] = [f"other{i}" for i in range(8)]
    once = items[1].split()[:38]
    for at in range(34, 3, -2):  # one n-gram is left
        once.insert(at, "added")
    texts = [words(rng, 80, 4000) for _ in range(200)]
    texts[20:120] = [words(rng, 20, 4000) + " " + " ".join(edited) + " " + words(rng, 20, 4000) for _ in range(100)]
    texts[150] = " ".join(once)
    want = {(i, 0): 0.6 for i in range(20, 120)} | {(150, 1): (38 - 16) / 40}
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_leaks(docs(spark, texts), bench).collect()}
    assert set(found) == set(want) and all(found[k] >= want[k] - 1e-9 for k in want)


def test_common_phrases_cost_little(monkeypatch):
    rng = random.Random(16)
    phrase = "which of the following is the right answer"
    items = [f"{phrase} {words(rng, 30, 9000)}".encode() for _ in range(4000)]
    text = f"{words(rng, 300, 9000)} {phrase} {words(rng, 300, 9000)}".encode()
    copy = f"{words(rng, 50, 9000)} {items[7].decode()} {phrase}".encode()
    it, aligned = decontam.Items([*range(4000)], items, 0.5, 3), []
    seen = np.zeros(len(it.grams), np.int64)
    h = decontam.gram_hashes(*decontam.word_hashes([decontam.plain(t) for t in (text, copy)]), 2)[0]
    np.add.at(seen, it.found(h)[1], 1)
    it.choose(seen)
    plain_align_ = decontam.align
    monkeypatch.setattr(decontam, "align", lambda q, p: aligned.append(1) or plain_align_(q, p))
    assert [m[:3] for m in decontam._matches(it, [text, copy])] == [(1, 7, 1.0)] and len(aligned) < 5


def test_pairs_always_suffice():
    # copies without a whole 3-gram, and with points on the limit
    item = [f"w{i}" for i in range(20)]
    spread = [x for i, w in enumerate(item) for x in ([w, "q"] if i % 2 else [w])][:29]
    for copy in (spread, item[:10], item[5:15], [*item[:6], "z", *item[7:13]]):
        it = decontam.Items([0], [" ".join(item).encode()], 0.5, 3)
        want = plain_align(item, copy)
        got = decontam._matches(it, [("a b " + " ".join(copy) + " c d").encode()])
        assert [m[2] for m in got] == ([pytest.approx(want)] if want >= 0.5 else [])


def test_decontamination_on_odd_and_empty_input(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (None, "null id here"), (1, "a b c d e f g")], "item_id long, text string")
    assert decontam.decontaminate(odd, bench).count() == 7
    assert decontam.find_leaks(empty, bench).count() == 0 and decontam.decontaminate(odd, bench.where("false")).count() == 11


# ----------------------------------------------------------------- 10 tokens


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁abcdehinorst\n\té中=-<>/s0x"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_counts_match_the_library(model, text):
    import sentencepiece

    counter = tokens.counter(model)
    assert counter.counts([text]) == [len(sentencepiece.SentencePieceProcessor(model_file=model).encode(text))]


def test_long_runs_match_the_library(model):
    import time

    import sentencepiece

    sp, rng = sentencepiece.SentencePieceProcessor(model_file=model), random.Random(41)
    texts = ["a" * 1_000_000, "ab" * 100_000 + "ba" * 99_999, "".join(rng.choice("aeinrst") for _ in range(300_000)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300_000)), "thereinthehouse" * 20_000]
    counter, began = tokens.counter(model), time.time()
    got = [counter.counts([t])[0] for t in texts]
    assert time.time() - began < 60
    assert got == [len(sp.encode(t)) for t in texts] and not any(len(w) > tokens.LONGEST for w in counter.known)


@settings(max_examples=300, deadline=None)
@given(st.text("aeinrst ", max_size=200))
def test_dense_text_matches_the_library(model, text):
    import sentencepiece

    assert tokens.counter(model).counts([text]) == [len(sentencepiece.SentencePieceProcessor(model_file=model).encode(text))]


def test_counts_of_documents(spark, odd, empty, model):
    import sentencepiece

    got = tokens.token_counts(odd, model).toPandas()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = sorted(len(sp.encode(r["text"] or "")) for r in odd.collect())
    assert sorted(got.n_tokens.tolist()) == want and (got.over_limit == (got.n_tokens > 4096)).all()
    assert tokens.token_counts(empty, model).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    item = words(rng, 30, 4000)
    texts = [words(rng, 120, 6000) for _ in range(240)]
    for i in range(0, 240, 6):
        t = texts[i].split()
        for k in (3, 50, 90):
            t[k] = rng.choice(["worthless", "pathetic", "moronic"])
        texts[i] = " ".join(t)
    texts[11] = texts[1] + " x"
    texts[13] = texts[7]
    texts[14] = words(rng, 50, 4000) + " " + item
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = set(range(240))
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:3], (set(range(0, 240, 6)), {11, 13}, {14}), strict=True):
        frame = common.staged(stage(spark, frame, str(tmp_path)), name)
        kept -= gone
        assert {r["doc_id"] for r in frame.select("doc_id").collect()} == kept, name
        assert frame.columns == [f.split()[0] for f in DOCS.split(", ")]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) <= kept and out["shard"].between(0, 7).all()
    assert out.groupby("doc_id").size().max() <= 3


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for name, table, kept in (("odd", odd, True), ("empty", empty, False)):
        d = str(tmp_path / name)
        table.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, None), (None, None, 1), (5, 0, 0)] if kept else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(None, None), (1, ""), (1, "no such words")] if kept else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        got = out.toPandas()
        assert set(DOCS.replace(",", "").split()[::2]) <= set(got.columns) and {"shard", "slot", "size"} <= set(got.columns)
        if kept:  # the text of 5 and 6 is one, blank texts are one each; a source without words is not taken
            assert {5.0, 7.0, 1.0} <= set(got.doc_id.dropna()) and not {6.0, 3.0, 2.0} & set(got.doc_id.dropna())
        else:
            assert len(got) == 0
