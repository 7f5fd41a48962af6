"""Forms of plans that keep work and memory in proportion to the input."""

import os

import pytest
from pyspark.sql import functions as F

from finsift.llm import toxicity
from finsift.operators import documents, guide, mapping
from finsift.plans import incremental, queries
from finsift.sources import work

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def grid(spark):
    rows = [(0, 0, "项目"), (0, 1, "期末余额"), (0, 2, "期初余额"), (1, 0, "资产总计")]
    cells = [(d, 2024, 0, "合并资产负债表", "元", r, c, t) for d in ("a_2024", "b_2024") for r, c, t in [*rows, (1, 1, "5"), (1, 2, "4")]]
    return spark.createDataFrame(cells, "doc string, year int, table_id int, title string, unit string, row int, col int, text string")


def test_headers_meet_the_vocabulary_only(spark):
    found = guide.header_guide(guide.headers(grid(spark)))
    assert optimized(found).count("Join ") == 1  # joined with themselves, they were broadcast through the driver
    got = {(r["doc"], r["row"], r["col"], r["role"], r["standard_name"], r["table_unit"]) for r in found.collect()}
    assert got == {(d, 1, c, role, "Total_Assets", "元") for d in ("a_2024", "b_2024") for c, role in ((1, "end_balance"), (2, "begin_balance"))}


def test_a_guide_is_never_broadcast(spark):
    cells = grid(spark)
    at = mapping.fetch_cells(cells.drop("title", "unit", "year"), guide.header_guide(guide.headers(cells)))
    assert "SortMergeJoin" in at._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc"], r["role"], r["text"]) for r in at.select("doc", "role", F.col("text")).collect()} == {(d, k, v) for d in ("a_2024", "b_2024") for k, v in (("end_balance", "5"), ("begin_balance", "4"))}


def test_texts_are_not_shuffled_to_their_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"wort{i % 7} zzbad und so" if i % 4 == 0 else f"wort{i % 5} und so weiter") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    plans, kind = [], type(docs)
    ask = kind.mapInArrow

    def asked(self, *args, **kwargs):
        if "text" in self.columns:
            plans.append(self._jdf.queryExecution().executedPlan().toString())
        return ask(self, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", asked)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with labels that are many
    try:
        toxicity.train(docs, labels, sample=20)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(plans) == 2 and not any("SortMergeJoin" in p for p in plans)


def test_tables_are_joined_in_one_pass(spark):
    rows = [(1, p, i, ["a", "1"]) for i, p in enumerate((0, 0, 1, 1, 2))] + [(1, 3, 5, ["a", "x"]), (1, 3, 6, None), (None, 0, 0, ["a"])]
    got = documents.joined_tables(spark.createDataFrame(rows, "doc int, page int, pos int, cells array<string>"))
    assert "Join" not in optimized(got)  # joined with themselves, rows were made and sorted three times
    assert sorted((r["pos"], r["table_id"]) for r in got.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_rescoring_writes_only_what_is_read(spark, monkeypatch):
    tags = []
    for m in (queries, incremental):
        monkeypatch.setattr(m, "staged", lambda df, tag: tags.append(tag) or work.staged(df, tag))
    queries.QUERIES["rescored"](spark, DATA)
    assert {"good", "outliers", "attribution"} <= set(tags)
    assert not {"context", "blocked", "impacts", "evidence", "scores"} & set(tags)
