"""Every query of the engine against its SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from finsift.plans.oracle import ORACLE_SQL
from finsift.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    def one(x):
        if pd.isna(x):
            return ""
        if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
            return repr(float(x) + 0.0)
        return str(x)

    return sorted(tuple(one(v) if not (isinstance(v, int) or hasattr(v, "dtype") and v.dtype.kind in "iu") else repr(float(v)) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    assert plain(QUERIES[name](spark, DATA).toPandas()) == plain(db.execute(ORACLE_SQL[name]).df())


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
