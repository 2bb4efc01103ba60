from paperloom.operators import reading as D

SCHEMA = "artifact_id bigint, block_id string, page int, ord int, role string, mode string, section string, text string, latex string, x double, y double, w double, h double"


def row(i, text="", page=1, role="BODY", at=(0.1, 0.1, 0.3, 0.03), mode="TEXT", section="S", artifact=1):
    return (artifact, f"b{i:02d}", page, i, role, mode, section, text, "", *at)


def test_roles_follow_the_reading(spark):
    lines = [
        ("Some Title", "TITLE"), ("Corresponding author is with X", "BODY"), ("Abstract. We read.", "BODY"), ("More of it", "BODY"), ("Keywords: a, b", "BODY"), ("1 Introduction", "BODY"), ("Words.", "BODY"),
        ("y = a x + b (3)", "BODY"), ("as shown in (3).", "BODY"), ("Figure 2: Things", "BODY"), ("Figure 2 shows things", "BODY"), ("Table 1. Rows", "BODY"), ("References", "BODY"), ("[1] A. B.", "BODY"),
    ]
    rows = [row(i, t, page=1 if i < 2 else 2, role=r, at=(0.1 if i < 2 else 0.6, 0.05 + 0.06 * i, 0.3, 0.02)) for i, (t, r) in enumerate(lines)]
    got = {r.block_id: (r.role, r.section) for r in D.read_roles(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in sorted(got)] == [
        ("TITLE", ""), ("MARGIN_METADATA", ""), ("ABSTRACT", "Abstract"), ("ABSTRACT", "Abstract"), ("ABSTRACT", "Abstract"), ("HEADING", "1 Introduction"), ("BODY", "1 Introduction"),
        ("FORMULA", "1 Introduction"), ("BODY", "1 Introduction"), ("CAPTION", "1 Introduction"), ("BODY", "1 Introduction"), ("CAPTION", "1 Introduction"), ("HEADING", "References"), ("REFERENCE", "References"),
    ]
    assert D.read_roles(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_footnote_runs_on_in_its_lane(spark):
    left, right = (0.1, 0.8, 0.3, 0.02), (0.6, 0.8, 0.3, 0.02)
    rows = [row(0, "Manuscript received May 3.", at=left), row(1, "More of the note.", at=left), row(2, "Other words.", at=right), row(3, "Left again.", at=left)]
    got = {r.block_id: r.role for r in D.read_roles(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"b00": "MARGIN_METADATA", "b01": "MARGIN_METADATA", "b02": "BODY", "b03": "BODY"}


def test_captions_run_on(spark):
    rows = [row(0, "Fig. 3: First line", at=(0.1, 0.50, 0.3, 0.02))] + [row(i, "goes on", at=(0.1, 0.50 + 0.025 * i, 0.3, 0.02)) for i in range(1, 8)]
    rows += [row(8, "", role="FIGURE", mode="REGION", at=(0.1, 0.2, 0.3, 0.2), artifact=2), row(0, "Figure 4 Setup", at=(0.1, 0.41, 0.3, 0.02), artifact=2), row(0, "Figure 4 Setup", at=(0.1, 0.41, 0.3, 0.02), artifact=3)]
    got = {(r.artifact_id, r.block_id): (r.number, r.depth) for r in D.caption_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, f"b{i:02d}"): ("3", i) for i in range(6)} | {(2, "b00"): ("4", 0)}


def test_mathematics(spark):
    texts = ["plain words", "", None, "so α_1 ≤ β^2 and x_i = y", "a=b ( c=d", "a=b words c=d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.level, r.signals, r.fragments, r.density) for r in D.math_profile(df, "t", ["i"]).collect()}
    assert got[0] == got[1] == got[2] == ("NONE", 0, 0, 0.0) and got[3][0] == "MATH_RICH"
    assert got[4][1:3] == (4, 1) and got[5][1:3] == (4, 2)
