from paperloom.operators import retrieval as Q
from paperloom.plans import registry

SOURCES = [
    ("a", 1, "TEXT", "这是深度学习模型的方法", "Intro"), ("b", 2, "FORMULA", "x = y (7)", ""), ("c", 3, "TEXT", "thresholding noisefloor", "Methods"),
    ("d", 4, "FIGURE", "Figure 12. Curves", ""), ("e", 5, "TEXT", "Модель сходится", ""), ("f", 6, "TEXT", "left ≈ right", ""), ("g", 7, "TEXT", "unrelated words", "Deep-learning"),
]


def found(spark, query):
    needs = spark.createDataFrame([("n", query)], "need_id string, query string")
    sources = spark.createDataFrame(SOURCES, "source_id string, page int, kind string, text string, section string")
    return [(r.source_id, r.score, r.routes) for r in sorted(Q.search(needs, sources).collect(), key=lambda r: r["rank"])]


def test_sources_without_a_shared_token_are_found(spark):
    assert found(spark, "学习模型") == [("a", 0.96, "EXACT_PHRASE")]
    assert found(spark, "about (7)")[0] == ("b", 1.0, "FORMULA_NUMBER")
    assert found(spark, "hold") == [("c", 0.96, "EXACT_PHRASE")]
    assert found(spark, "noise floor") == [("c", 0.72, "TOKEN_COVERAGE")]
    assert found(spark, "see fig 12 there")[0][:2] == ("d", 1.0)
    assert found(spark, "≈") == [("f", 0.96, "EXACT_PHRASE")]
    assert found(spark, "deep learning") == [("g", 0.9, "TOKEN_COVERAGE+SECTION")]


def test_texts_without_tokens_by_their_beginning(spark):
    assert found(spark, "модели") == [("e", 0.6, "TOKEN_COVERAGE")]
    assert found(spark, "мост") == [("e", 0.36, "TOKEN_COVERAGE")]
    assert {s for s, _, _ in found(spark, "x")} == {"b"}
    assert found(spark, " ") == []


def test_typed_search_has_the_needs_of_all_calls(spark, tmp_path):
    need = '{"needs": [{"query": "noise floor", "contentTypes": ["TEXT"]}]}'
    calls = spark.createDataFrame([(1, "r", need), (20, "r", need), (39, "r", need)], "id bigint, run_id string, arguments_json string")
    blocks = '[{"id": "b", "page": 1, "role": "PARAGRAPH", "text": "the noise floor"}]'
    calls.write.parquet(f"{tmp_path}/agent_tool_call.parquet")
    spark.createDataFrame([(7, 1, 1, blocks)], "id bigint, paper_id bigint, page_count int, blocks_json string").write.parquet(f"{tmp_path}/paper_layout_artifact.parquet")
    assert {r.need_id for r in registry.queries()["ret_typed"](spark, str(tmp_path)).collect()} == {"1-0", "20-0", "39-0"}
    assert "id % 20" not in registry.oracle_sql()["ret_typed"]
