import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators.nested import _parse_deep, linked, node_table, objects_with_lists, plain_name, walk, whole_value


def test_whole_value_takes_off_wrappings():
    inner = {"a": [1, None]}
    text = json.dumps(inner)
    for t in (text, "﻿" + text, f"```json\n{text}\n```", json.dumps(text), json.dumps(json.dumps(text)), f"  {text}\n", f"```\n{json.dumps(text)}\n```"):
        assert whole_value(t) == inner
    for t in (None, "", " ", text[:-1], "```json\n{", "[1,", "nope", "{'a': 1}", text + "x"):
        assert not isinstance(whole_value(t), (dict, list))


def test_names():
    assert plain_name("core_contributions") == plain_name("coreContributions") == plain_name("Core-Contributions")


def test_labels_nest():
    nodes = list(walk({"a": [{"b": 1}, None, [2]], "c": "x"}, "b"))
    assert len({n[0] for n in nodes} | {n[1] for n in nodes}) == 2 * len(nodes)
    for n in nodes:
        for m in nodes:
            assert (n[0] < m[0] < n[1]) == (n[0] < m[1] < n[1])
    assert next(n for n in nodes if n[6] == "object" and n[4] == "a")[7] == "1"


def test_deep_json_and_repeated_rows(spark):
    deep = "[" * 300 + "]" * 300
    rows = [(1, '{"needs":[{"targets":["x",null,"y"]},null,{"targets":"z"}]}'), (1, '{"needs":[{"targets":["x",null,"y"]},null,{"targets":"z"}]}'), (2, None), (3, ""), (4, deep), (5, '{"data":{"needs":{"targets":"\\ud835"}}}')]
    df = spark.createDataFrame(rows, "id bigint, j string").withColumn("pre", F.lit(1)).withColumn("record_id", F.lit("clash"))
    nodes = node_table(df, "id", "j", ["needs", "targets"]).filter("kind not in ('array', 'null')")
    got = linked(nodes, F.col("name") == "needs", F.col("name") == "targets", ["record_id", "row_no"])
    out = sorted((r.record_id, r.parent_list_pos, r.list_pos, r.value) for r in got.distinct().collect())
    assert out == [(1, 0, 0, "x"), (1, 0, 0, "x"), (1, 0, 2, "y"), (1, 0, 2, "y"), (1, 2, 0, "z"), (1, 2, 0, "z"), (5, 0, 0, "?")]


def test_any_depth_and_any_number_of_quotings(spark):
    deep = 20_000
    text = '{"needs":{"targets":["x"]},"more":' + '{"a":[' * deep + "1" + "]}" * deep + "}"
    quoted = json.dumps({"needs": [{"targets": "q"}]})
    for _ in range(9):
        quoted = json.dumps(quoted)
    df = spark.createDataFrame([(1, text), (2, quoted), (3, text[:-1])], "id bigint, j string")
    nodes = node_table(df, "id", "j", ["needs", "targets"]).filter("kind not in ('array', 'null')")
    got = linked(nodes, F.col("name") == "needs", F.col("name") == "targets", ["record_id", "row_no"])
    assert sorted((r.record_id, r.value) for r in got.collect()) == [(1, "x"), (2, "q")]
    assert node_table(df.filter("id = 1"), "id", "j").count() == 2 * deep + 5


def test_deep_reader_agrees_with_the_plain_one():
    good = ['{"a": [1, {"b": null}, "x\\"y", [], {}, -1.5e3], "a": true}', "[]", "{}", ' [ [ ] , { "k" : [ 0 ] } ] ', '"s"', "12", "[NaN]"]
    bad = ["[1,]", "[1 2]", '{"a" 1}', "{1: 2}", "[", '{"a":1,}', "[1]]", "", "[1}", "nope", '{"a":}', "[,]"]
    for t in good:
        assert repr(_parse_deep(t)) == repr(json.loads(t))
    for t in bad:
        with pytest.raises(ValueError):
            _parse_deep(t)


def test_children_after_a_nested_parent_are_kept(spark):
    text = '{"needs":[{"targets":["a"],"sub":{"needs":{"targets":"b"}},"later":{"targets":"c"}}],"targets":"outside"}'
    nodes = node_table(spark.createDataFrame([(1, text)], "id bigint, j string"), "id", "j", ["needs", "targets"]).filter("kind not in ('array', 'null')")
    got = linked(nodes, (F.col("name") == "needs") & (F.col("kind") == "object"), F.col("name") == "targets", ["record_id", "row_no"])
    rows = {r.value: r.parent_pre for r in got.collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"] == rows["c"] < rows["b"]


def test_empty(spark):
    assert node_table(spark.createDataFrame([], "id bigint, j string"), "id", "j").count() == 0


def test_objects_with_lists_take_the_nearest_object_around(spark):
    texts = ['{"needs": [{"query": "a", "targets": ["x", null, 2], "content_types": "TEXT"}, {"Query": "b", "in": {"needs": {"query": "c", "targets": ["y"]}}, "targets": ["z"]}, 5], "targets": ["out"]}', "damaged {", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = [tuple(r) for r in objects_with_lists(df, "t", "needs", "query", ["targets", "contentTypes"]).collect()]
    assert sorted(got) == [(0, 0, "a", ["x", "2"], ["TEXT"]), (0, 0, "c", ["y"], []), (0, 1, "b", ["z"], [])]
