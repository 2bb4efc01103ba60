"""Every registered query of the core with a DuckDB text gives the same rows, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import paperloom
from paperloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if v.__class__.__name__ in ("datetime", "Decimal") else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, tables, name):
    df = registry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = tables.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    """What SQL can't express is computed whole; the same rows come whatever the partitions (what they are is tested with
    their operators)."""
    df = registry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows == sorted(repr([plain(r[c]) for c in cols]) for r in registry.queries()[name](spark, FOLDER).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_core_does_not_import_the_subpackage():
    root = os.path.dirname(paperloom.__file__)
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "paperloom.llm" not in open(path).read(), path
