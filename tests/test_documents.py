import json
import random

import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions import chunks as C
from paperloom.functions import geometry as G
from paperloom.functions import metadata as M
from paperloom.functions import text as T
from paperloom.operators import layout as L
from paperloom.operators.glyphs import agreed_gutter, glyph_lines, gutter_of, rows_of


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()))
    return df.select(column(F) if callable(column) else column).first()[0]


def blocks_frame(spark, blocks, **extra):
    body = json.dumps([{"id": b[0], "page": b[1], "readingOrder": i, "role": b[2], "text": b[3], "bbox": dict(zip(("x", "y", "width", "height"), b[4])), "sectionPath": ["S"], "confidence": 0.9, "contentMode": "TEXT"} for i, b in enumerate(blocks)])
    rows = [(1, 7, 2, body), (2, 7, 2, None), (3, 7, 2, body[:-3]), (4, 7, 0, "[]")]
    return spark.createDataFrame(rows, "id bigint, paper_id bigint, page_count int, blocks_json string").withColumn("role", F.lit("clash"))


BLOCKS = [
    ("a", 1, "HEADING", "1 Results", (0.1, 0.05, 0.8, 0.02)),
    ("b", 1, "BODY", "The first block ends with a hyphen-", (0.1, 0.10, 0.3, 0.05)),
    ("c", 1, "BODY", "ated word.", (0.1, 0.16, 0.3, 0.05)),
    ("d", 1, "TABLE", "1 2", (0.1, 0.30, 0.3, 0.05)),
    ("e", 1, "CAPTION", "Table 1", (0.1, 0.36, 0.3, 0.02)),
    ("f", 2, "FORMULA", "x = y + 1 (3)", (0.6, 0.2, 0.3, 0.05)),
    ("g", 2, "BODY", "", (0.6, 0.3, 0.3, 0.05)),
]


def test_blocks_pages_and_neighbours(spark):
    a = blocks_frame(spark, BLOCKS)
    b = L.layout_blocks(a)
    assert b.count() == len(BLOCKS)
    pages = {(r.artifact_id, r.page): r.n for r in L.every_page(b, a.select("id", "page_count"), {"n": F.count("*")}).collect()}
    assert pages[1, 1] == 5 and pages[1, 2] == 2 and pages[2, 1] is None and (4, 1) not in pages
    near = L.nearest_above(b.filter("role = 'CAPTION'"), b.filter("role = 'TABLE'"), 0.2).first()
    assert (near.other_id, near.gap) == ("d", 0.01)
    assert L.latest_before(b, F.col("role") == "HEADING", F.col("role") == "FORMULA").first().owner_id == "a"
    n = L.neighbours(b, F.col("role") == "TABLE", F.length("text") > 0).first()
    assert (n.before_id, n.after_id) == ("c", "e")
    text = [r.text for r in L.paragraphs(b).orderBy("paragraph").collect()]
    assert text == ["The first block ends with a hyphenated word.", ""]
    assert [r.block_id for r in L.geometric_order(b).orderBy("place").collect()] == list("abcdefg")


def test_spans_fold(spark):
    rows = [(f"b{i:02d}", 1, "BODY", "x" * 100, (0.1, 0.02 + i * 0.04, 0.3, 0.03)) for i in range(20)]
    s = L.spans(L.layout_blocks(blocks_frame(spark, rows))).orderBy("span_id").collect()
    assert [(r.span_id, r.blocks, r.characters) for r in s] == [("p1-s0000", 12, 1200), ("p1-s0001", 8, 800)]


def test_section_stack(spark):
    rows = [(1, 0, "a", 1), (1, 1, "b", 2), (1, 2, "c", 3), (1, 3, "d", 2), (1, 4, "e", None), (1, 5, "f", 3)]
    got = {r.section_id: r.parent_id for r in L.section_parents(spark.createDataFrame(rows, "k int, pos int, section_id string, level int"), ["k"]).collect()}
    assert got == {"a": None, "b": "a", "c": "b", "d": "a", "e": None, "f": "e"}


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.5, 0.5, 0.25, 0.25, 0.5, 0.5), (0.0, 0.0, 0.0, 0.0, 0.1, 0.1, 0.2, 0.2), (None,) * 8], ", ".join(f"{p}_{c} double" for p in "ab" for c in "xywh"))
    a, b = G.box("a_"), G.box("b_")
    rows = df.select(F.round(G.overlap(a, b), 4), F.round(G.iou(a, b), 4), F.round(G.coverage(a, b), 4), G.valid(a)).collect()
    assert tuple(rows[0]) == (0.25, round(1 / 7, 4), 0.25, True)
    assert tuple(rows[1]) == (0.0, 0.0, 0.0, False) and rows[2][3] is False


def test_text_functions(spark):
    cases = [
        (lambda c: T.collapsed(c), " a \n b ", "a b"), (lambda c: T.is_heading(c), "2.1 Setup of it", True), (lambda c: T.is_heading(c), "RELATED WORK", True),
        (lambda c: T.is_heading(c), "a sentence.", False), (lambda c: T.is_heading(c), None, False), (lambda c: T.is_formula(c), "x = y + [1]", True), (lambda c: T.is_formula(c), "plain words", False),
        (lambda c: T.ends_sentence(c), "好。 ", True), (lambda c: T.language(c), "双栏 ab", "ZH"), (lambda c: T.language(c), "words", "EN"), (lambda c: T.language(c), None, None),
        (lambda c: T.fingerprint(c), "Page 12 of 99!", "page # of #"), (lambda c: T.redacted(c), "Bearer abc.def api_key=xyz", "Bearer *** api_key=***"),
        (lambda c: T.words_of_name(c), "readPaperProfile_v2", "read paper profile v2"), (lambda c: T.shortened(c, 4), "abcdef", "abc…"), (lambda c: T.nfkc(c), "ﬁ２", "fi2"),
        (lambda c: T.unescape(c), "a &amp; b &#x41;", "a & b A"), (lambda c: M.find_doi(c), "see doi:10.1234/AB.c5).", "10.1234/ab.c5"), (lambda c: M.find_arxiv(c), "arXiv:2101.00001v2", "2101.00001"),
        (lambda c: M.bare_doi(c), "https://doi.example/10.1/X", "10.1/x"), (lambda c: M.bare_doi(c), " ", None), (lambda c: M.clean_title(c), "<i>A</i>  b", "A b"),
        (lambda c: C.restore(C.protect(c)), "run `x` at 5 ms [3]", "run `x` at 5 ms [3]"), (lambda c: C.clean_latex(c), "```latex\n$x^2$\n```", "x^2"), (lambda c: C.clean_latex(c), "$$", None),
        (lambda c: F.array_join(M.author_list(c), "|"), "A B; C, D;", "A B|C, D"), (lambda c: F.array_join(T.tokens(c), "|"), "Glyph_box 双栏 a α1", "glyph_box|双栏|α1"),
    ]
    df = spark.createDataFrame([tuple(c[1] for c in cases)], ", ".join(f"c{i} string" for i in range(len(cases))))
    got = df.select(*[f(F.col(f"c{i}")).alias(f"o{i}") for i, (f, _, _) in enumerate(cases)]).first()
    for i, (_, given, want) in enumerate(cases):
        assert got[i] == want, (given, got[i], want)


def test_chunks_batches_and_latex(spark):
    rnd = random.Random(0)
    for n in (0, 1, 50, 51, 400):
        text = "".join(rnd.choice("ab. \n。;") for _ in range(n))
        cuts = C.cut_text(text, 50)
        assert "".join(text[a:b] for a, b in cuts) == text and all(0 < b - a <= 50 for a, b in cuts)
    assert C.cut_text(None, 5) == []
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 5, 5, 30, 1, 1, 1, 1])], "g int, no int, size int")
    assert [r.batch for r in C.batches(df, "g", ["no"], "size", 3, 12).orderBy("no").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]
    assert C.latex_of("α ≤ x²") == (r"\alpha  \leq  x^{2}", "READY") and C.latex_of("plain") == (None, "UNAVAILABLE") and C.latex_of(None)[1] == "UNAVAILABLE"
    assert C.compacted('{"a":[1,2,3],"b":{"c":{"d":1}}}', 2, 2, 5) == '{"a": [1, 2], "b": {"c": "…"}}' and C.compacted("{") is None
    assert C.resolve_template("{{a.b}}-{{x}}", {"a": {"b": "1"}}) == "1-"


def test_glyphs_to_lines(spark):
    rows = []
    for page in (1, 2):
        for r in range(6):
            for x0, word in ((60.0, "left"), (330.0, "right")):
                rows += [(1, page, c, x0 + 6 * i + 40 * k, 100.0 + 12 * r + (0.3 if i % 2 else 0.0), 6.0, 10.0) for k, w in enumerate((word, f"r{r}")) for i, c in enumerate(w)]
        rows += [(1, page, c, 60.0 + 6 * i, 60.0, 6.0, 10.0) for i, c in enumerate("a" * 80)]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, text string, x double, y double, w double, h double")
    lines = glyph_lines(df).collect()
    assert [(r.lane, r.text) for r in lines if r.page == 1][:3] == [("FULL", "a" * 80), ("LEFT", "left r0"), ("RIGHT", "right r0")]
    assert len(lines) == 26 and glyph_lines(df.limit(0)).count() == 0
    page = pd.DataFrame(rows, columns=["doc_id", "page", "text", "x", "y", "w", "h"]).query("page == 1")
    assert abs(gutter_of(rows_of(page), 612.0) - 236) < 120
    assert agreed_gutter({1: 300.0, 2: 302.0, 3: None}, 612.0) == {1: 301.0, 2: 301.0, 3: 301.0} and agreed_gutter({1: None}, 612.0) == {1: None}


def test_structure_violations(spark):
    s = json.dumps({"pageCount": 2, "sections": [{"id": "s1", "parentId": "zz"}], "elements": [{"id": "e", "page": 3, "content": " ", "blockIds": []}, {"id": "e", "page": 1, "content": "x", "blockIds": ["b"]}]})
    df = spark.createDataFrame([(1, 1, s), (2, 1, None), (3, 1, "{")], "id bigint, paper_id bigint, structure_json string")
    got = {r.violation: r.n for r in L.structure_violations(L.structures(df)).collect()}
    assert got == {"element_repeated": 1, "element_without_blocks": 1, "element_page": 1, "element_blank": 1, "section_parent": 1, "element_type": 2, "element_order": 1, "section_level": 1}
