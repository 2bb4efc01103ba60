"""The subpackage's queries over the smallest tables, against DuckDB where SQL can express them."""

import glob
import os

import duckdb
import pytest

from paperloom.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, FOLDER)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for path in glob.glob(f"{FOLDER}/*.parquet"):
            con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        rel = con.sql(Q.oracle_sql()[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
