"""The queries of the training-data operators on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from codelode.llm import queries, tokens  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p2_found": ["id_a", "id_b"], "p3_found": ["file_path"], "p4_found": ["id"], "p5_found": ["id", "line_no"], "p6_found": ["id_a", "id_b"], "p7_found": ["file_path"],
    "p10_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name.startswith(("p8", "p9")) and not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary file")
    frame = queries.QUERIES[name](spark, DATA)
    rows = frame.collect()
    assert frame.columns == COLUMNS.get(name, frame.columns)
    if name.endswith("_found"):
        assert rows and len(set(rows)) == len(rows)
        if len(frame.columns) == 2 and name != "p5_found":
            assert all(a < b for a, b in rows)
    if name in queries.SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        want = con.execute(queries.SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(frame.columns)
        order = [names.index(c) for c in frame.columns]
        plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
        assert sorted((plain(r) for r in rows), key=str) == sorted((plain(tuple(x[i] for i in order)) for x in want.fetchall()), key=str)
