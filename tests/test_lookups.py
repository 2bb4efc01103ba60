"""What SQL can't express among the lookups, against plain Python."""

import json
import os

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import retrieval as Q
from paperloom.operators.nested import walk, whole_value
from paperloom.plans import lookups as K
from paperloom.plans import texts as X
from paperloom.session import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_new_sources_of_a_run(spark):
    calls = [r for r in table(spark, FOLDER, "agent_tool_call").select("id", "run_id", "ordinal_no", "result_json").collect() if r.run_id]
    want, seen = {}, {}
    for r in sorted(calls, key=lambda r: (r.ordinal_no is not None, r.ordinal_no or 0, r.id)):
        value = whole_value(r.result_json)
        own = {n[7] for n in walk(value, "sourceid") if n[4] == "sources" and n[6] == "object" and n[7] is not None} if isinstance(value, (dict, list)) else set()
        if own:
            before = seen.setdefault(r.run_id, set())
            want[r.id] = (len(own), len(own - before), "new_sources" if own - before else "same_sources")
            before |= own
    got = {r.id: (r.sources, r.new, r.outcome) for r in K.run_sources(spark, FOLDER).collect()}
    assert want and got == want


def test_texts_are_found_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "AUTOMATON", 6)
    sources = spark.createDataFrame([("a", 1, "T", "abcdef"), ("b", 2, "T", None), ("c", 3, "T", "xbcx")], "source_id string, page int, kind string, t string")
    texts = spark.createDataFrame([(x,) for x in ("abc", "bc", "def", "zzz", "x")], "x string")
    got = sorted((r.source_id, r.found) for r in Q.containing(texts, sources, ["t"]).collect())
    assert got == [("a", "abc"), ("a", "bc"), ("a", "def"), ("c", "bc"), ("c", "x")]
    assert Q.containing(texts.limit(0), sources, ["t"]).count() == 0


def test_issues(spark, tmp_path):
    rows = [(1, json.dumps({"needs": [{"query": " ", "targets": ["x"]}, {"query": "q", "targets": [None]}]})), (2, json.dumps({"needs": [{"query": "q", "targets": "t"}] * 7})), (3, None), (4, "nothing")]
    spark.createDataFrame(rows, "id bigint, arguments_json string").withColumn("code", F.lit("clash")).write.parquet(f"{tmp_path}/agent_tool_call.parquet")
    got = sorted((r.call_id, -1 if r.need_no is None else r.need_no, r.code) for r in K.run_issues(spark, str(tmp_path)).collect())
    assert got == [(1, 0, "QUERY_MISSING"), (1, 1, "TARGETS_MISSING"), (2, -1, "TOO_MANY_NEEDS")]


def test_topics_and_failures(spark):
    rows = [("Age of Information in IoT", "AAoI"), ("a drone", "UAV"), (None, "OTHER"), ("soundtracks", "OTHER"), ("系统可达速率", "Sum Rate")]
    got = [r.t for r in spark.createDataFrame(rows, "x string, want string").select(X.topic_of(F.col("x")).alias("t")).collect()]
    assert got == [w for _, w in rows]
    errors = [("Read timed out", "MODEL_TIMEOUT"), ("HTTP 429", "MODEL_OVERLOADED"), ("socket closed", "MODEL_CONNECTION_FAILED"), ("odd", "AGENT_INTERNAL_ERROR")]
    got = [r.t for r in spark.createDataFrame(errors, "x string, want string").select(T.classified(F.col("x"), X.FAILURES, "AGENT_INTERNAL_ERROR").alias("t")).collect()]
    assert got == [w for _, w in errors]
