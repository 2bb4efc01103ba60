import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import splitting as S

TEXTS = st.text(st.sampled_from("ab c.\n。，,中é́!\r"), max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from([(40, 0), (40, 7), (60, 20), (120, 1)]))
def test_pieces_cover_within_the_limit(text, sizes):
    limit, overlap = sizes
    pieces = S.split_points(text, limit, overlap)
    assert (not pieces) == (not text)
    if pieces:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b - a <= limit for a, b in pieces)
        assert all(q[0] == p[1] - overlap and q[1] > p[1] for p, q in zip(pieces, pieces[1:]))
        assert (len(pieces) == 1) == (len(text) <= limit)


def test_cuts_fall_on_natural_boundaries():
    text = ("word " * 30).strip() + ".\n\n" + ("other " * 30).strip() + "."
    (a, b), (c, d) = S.split_points(text, 250, 10)
    assert text[:b].endswith(".\n\n") and c == b - 10


def test_no_boundaries_and_long_texts():
    for text in ("x" * 5000, "\n" * 5000, "中" * 3000, "é" * 2500, "é" * 1201, "a" * 200_000):
        pieces = S.split_points(text)
        assert len(pieces) >= -(-(len(text) - 1200) // 1100) + 1 and all(b - a <= 1200 for a, b in pieces)


def test_optimum_on_a_small_case():
    text = "aaaa bbbb cccc dddd. eeee ffff"
    at, price = S.boundaries(text, 22)
    pieces = S.split_points(text, 24, 2)
    even = len(text) / (1 + -(-(len(text) - 24) // 22))
    cost = lambda cuts: sum(1 + 6 * ((b - a) / even - 1) ** 2 for a, b in zip([0, *cuts], [*cuts, len(text)])) + sum(price[list(at).index(c)] for c in cuts)
    best = min((cost([c]) for c in at.tolist() if 2 <= c <= 24 and len(text) - c <= 22))
    assert len(pieces) == 2 and abs(cost([pieces[0][1]]) - best) < 1e-9


def test_tables(spark):
    long_ = "Sentence one. " * 120
    good = json.dumps([{"id": "b1", "text": long_}, {"id": 7, "text": "short"}, {"id": "b3", "text": None}, {"id": "b4"}, None, {"id": "b5", "text": ""}, {"text": long_}])
    rows = [(1, good), (1, good), (2, None), (3, ""), (4, good[:-1]), (5, "null"), (6, '{"blocks": [{"id": "\\ud800", "text": "x"}]}')]
    df = spark.createDataFrame(rows, "id bigint, blocks_json string").withColumn("item_id", F.lit("clash"))
    memory = spark.createDataFrame([(9, json.dumps({"elements": [{"id": "e", "content": "é" * 1201}, {"id": "e", "content": "y" * 1201}]}))], "id bigint, structure_json string")
    pieces = S.split_tables(df, memory)
    found = sorted((r.record_table, r.record_id, r.item_id or "") for r in S.oversized_items(pieces).collect())
    assert found == [("paper_layout_artifact", 1, ""), ("paper_layout_artifact", 1, "b1"), ("paper_memory", 9, "e")]
    assert pieces.filter("record_id = 1 and item_id = 'b1'").agg(F.max(F.length("piece"))).first()[0] <= 1200
    assert pieces.filter("record_id in (2, 3, 4, 5)").count() == 0 and pieces.filter("item_id = '7'").count() == 2
    assert S.split_tables(df.limit(0), memory.limit(0)).count() == 0
