"""Every core query against its SQL, on the smallest tables."""

import glob
import math
import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from codelode.plans import core_queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v) or v is pd.NaT:
            return "None"
        if isinstance(v, float):
            return repr(round(v, 6))
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core_queries.SQL))
def test_same_rows(spark, db, name):
    got = core_queries.QUERIES[name](spark, DATA).toPandas()
    want = db.execute(core_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.SQL)))
def test_runs(spark, name):
    assert core_queries.QUERIES[name](spark, DATA).count() > 0
