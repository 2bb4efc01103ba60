from types import SimpleNamespace

from paperloom.operators import units as U


def block(i, text="", page=1, role="BODY", at=(0.1, 0.1, 0.3, 0.03), mode="TEXT", section="S", confidence=0.9):
    return SimpleNamespace(block_id=f"b{i:02d}", ord=i, page=page, role=role, mode=mode, section=section, text=text, latex="", confidence=confidence, x=at[0], y=at[1], w=at[2], h=at[3])


def test_formula_regions_grow_and_stop_at_prose():
    rows = [block(0, "a = b + [c]", at=(0.1, 0.10, 0.3, 0.02)), block(1, "d = e + [f] (1)", at=(0.1, 0.13, 0.3, 0.02)), block(2, "Plain words stand here.", at=(0.1, 0.155, 0.3, 0.005)), block(3, "g = h + [i]", at=(0.1, 0.165, 0.3, 0.02)), block(4, "j = k + [l] (2)", at=(0.1, 0.19, 0.3, 0.02))]
    assert U.formula_regions(rows) == [("b00", 1, "1", 2), ("b03", 1, "2", 2)]


def test_equations_prefer_confidence_then_place():
    rows = [block(0, "see (1)"), block(1, "x = 1 (1)", page=2, confidence=0.80), block(2, "x = 1 (1)", page=3, confidence=0.85), block(3, "x = 1 (1)", page=4, confidence=0.95), block(4, "by (7)")]
    assert U.equations(rows) == [("1", "b03", 4, 3), ("7", None, None, 1)]


def test_algorithms():
    rows = [block(0, "Algorithm 2 is shown below."), block(1, "Alg. 1: Sorting"), block(2, "1. for each x"), block(3, "2. return y"), block(4, "aside", at=(0.7, 0.1, 0.2, 0.02)), block(5, "Algorithm 3 Other"), block(6, "no steps here")]
    assert U.algorithms(rows) == [("algorithm:1", 1, 3, "b03")]


def test_regions_boxes_math_and_places():
    a, b, c = block(0, at=(0.1, 0.1, 0.1, 0.1), confidence=0.1), block(1, at=(0.21, 0.1, 0.1, 0.1), confidence=0.1), block(2, at=(0.8, 0.8, 0.1, 0.1), confidence=0.1)
    assert [[x.block_id for x in r] for r in U.merged_regions([a, b, c])] == [["b00", "b01"], ["b02"]]
    assert U.doubtful_regions([a, b, c]) == [("lr-p1-001", 1, 2), ("lr-p1-002", 1, 1)]
    assert U.line_boxes([(0.1, 0.1, 0.1, 0.02), (0.3, 0.105, 0.1, 0.02), (0.1, 0.2, 0.1, 0.02)])[1] == (0.1, 0.2, 0.1, 0.02)
    assert U.locate("Hello World", [("p", "say hel-"), ("q", "lo, world!")]) == [("p", 4, 7), ("q", 0, 9)] and U.locate("absent", [("p", "x")]) == [] and U.locate("", [("p", "x")]) == []


def test_titles_recoveries_and_runs():
    rows = [block(0, "A Study of Glyph Boxes", at=(0.2, 0.1, 0.6, 0.03)), block(1, "Ann Author, Bo Writer", at=(0.2, 0.15, 0.6, 0.03)), block(2, "Abstract Ann Author", at=(0.2, 0.2, 0.6, 0.03)), block(3, "Ann Author", at=(0.2, 0.9, 0.6, 0.03))]
    assert U.title_and_authors(rows, "A Study of Glyph Boxes", "Ann Author; Bo Writer") == {"b00": "TITLE", "b01": "AUTHOR"}
    assert U.title_and_authors(rows, None, None) == {}
    assert U.accepts_recovery({"a": "one two three"}, {"a": "one two THREE!"}) and not U.accepts_recovery({"a": "one two"}, {"a": "other words"})
    assert not U.accepts_recovery({"a": "x"}, {"b": "x"}) and not U.accepts_recovery({"a": "one"}, {"a": "one " * 100})
    assert U.run_kinds([("so ", False, False), ("we ", False, False), ("α≤β", False, False), ("x = y", True, True), ("", False, False)]) == [("TEXT", "so we "), ("INLINE_MATH", "α≤β"), ("DISPLAY_MATH", "x = y"), ("TEXT", "")]
