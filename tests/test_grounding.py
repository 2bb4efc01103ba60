from pyspark.sql import functions as F

from paperloom.operators import grounding as N
from tests.test_units import block


def test_copies():
    a = block(0, "The same text stands here", at=(0.1, 0.1, 0.3, 0.1), confidence=0.8)
    b = block(1, "the same text stands here!", at=(0.1, 0.1, 0.3, 0.1), confidence=0.9)
    c = block(2, "The same text stands here", at=(0.6, 0.6, 0.3, 0.1))
    long_ = "words that fill forty characters and then some more of them"
    d, e = block(3, long_, at=(0.1, 0.8, 0.3, 0.05)), block(4, long_ + " and on", at=(0.105, 0.8, 0.3, 0.05))
    assert dict(N.physical_copies([a, b, c, d, e])) == {"b00": "b01", "b01": "b01", "b02": "b02", "b03": "b04", "b04": "b04"}
    assert N.physical_copies([]) == []
    f, g, h = block(5, "x = 1 (3)", role="FORMULA", at=(0.1, 0.1, 0.3, 0.1)), block(6, "X=l (3)", role="FORMULA", at=(0.12, 0.11, 0.3, 0.1), confidence=0.5), block(7, "y (4)", role="FORMULA", at=(0.1, 0.1, 0.3, 0.1), confidence=0.4)
    assert dict(N.physical_copies([f, g, h])) == {"b05": "b05", "b06": "b05", "b07": "b07"}


def test_citations_and_markers():
    text = "First claim. Second claim here [S2][S3]. `x [S9]` Third [S1]"
    assert [(label, text[a:b]) for label, a, b in N.citations(text)] == [("S2", "Second claim here"), ("S3", "Second claim here [S2]"), ("S1", "`x [S9]` Third")]
    assert N.without_markers(text) == "First claim. Second claim here. `x [S9]` Third" and N.without_markers(None) is None and list(N.citations(None)) == []
    assert N.with_markers("One two. Three  four.", [("Three four", "S1"), ("", "S2"), ("absent", "S3")]) == "One two. Three  four [S1]."


def test_levels_families_and_restriction(spark):
    rows = [("a", i, "x" * 350) for i in range(9)] + [("b", 0, "short"), ("c", 0, None)]
    df = spark.createDataFrame(rows, "g string, t int, x string")
    got = {r.g: (r.level, r.messages, r.tokens) for r in N.context_levels(df, "g", [F.col("t").desc()], F.col("x"), 450).collect()}
    assert got == {"a": (2, 4, 400), "b": (0, 1, 2), "c": (0, 1, 0)}
    hits = spark.createDataFrame([("n", "12a", 1.0)], "need_id string, label string, score double")
    labels = spark.createDataFrame([("12a",), ("12b",), ("1a",)], "label string")
    assert {(r.label, round(r.score, 2)) for r in N.family_members(hits, labels).collect()} == {("12a", 1.0), ("12b", 0.99)}
    df = spark.createDataFrame([("n", "FIGURE"), ("n", "TEXT"), ("m", "TEXT"), ("k", None)], "n string, k string")
    assert sorted(tuple(r) for r in N.restricted(df, "n", F.col("k") == "FIGURE").collect() if r.k) == [("m", "TEXT"), ("n", "FIGURE")]
