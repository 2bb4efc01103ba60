import json

from pyspark.sql import functions as F

from paperloom.operators import validation as V


def test_claims(spark):
    good = {"category": "RESULT", "statement": "s", "confidence": 0.4, "evidenceBlockIds": ["a"]}
    rows = [
        (1, json.dumps({"k": [good]})), (2, json.dumps({"k": [None, {"statement": " ", "category": "RESULT"}, {"statement": " t ", "category": "odd", "confidence": 7, "evidenceBlockIds": [" a", "a", ""]}]})),
        (3, "{"), (4, None), (5, json.dumps({"k": [good] * 130})), (6, json.dumps({"k": []})),
    ]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("c", V.parsed_claims("j", "k"))
    got = {r.id: (r.i, r.r) for r in df.select("id", V.claim_issues(F.col("c")).alias("i"), V.repaired_claims(F.col("c")).alias("r")).collect()}
    assert got[1][0] == [] and got[6] == ([], [])
    assert got[2][0] == ["BLANK_STATEMENT", "CATEGORY", "CONFIDENCE", "NO_EVIDENCE"]
    assert [tuple(c) for c in got[2][1]] == [("OTHER", "t", 1.0, ["a"])]
    assert got[3] == (["MISSING"], None) and got[4] == (["MISSING"], None)
    assert got[5][0] == ["TOO_MANY"] and len(got[5][1]) == 130
    claims = spark.createDataFrame([(1, 7, ["a", "b", "a"]), (2, 7, []), (3, 8, ["a"])], "claim_id int, p int, ids array<string>")
    known = spark.createDataFrame([(7, "a"), (7, "a"), (7, "b")], "p int, block_id string")
    assert sorted(tuple(r) for r in V.grounded(claims, known, ["p"]).collect()) == [(1, 2, 2), (2, 0, 0), (3, 1, 0)]
