import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.llm import sentences as S

CASES = [
    ["He said \"Stop. Now.\" and left.", "She asked, \"Why?\"", "Nobody knew."],
    ["Dr. Smith met Mr. A. B. Jones at 5 p.m.", "The end."],
    ["See Fig. 3.", "It shows e.g. this.", "Costs $3.50.", "OK?"],
    ["Both belong to group A.", "As in App. C, the claim by M. Ono et al. (2013) holds.[9]", "Next."],
    ["It fails ... and then rises.", "Nothing changed…", "Really?!", "[5] reports it."],
    ["(This is a note.)", "Then text (see Fig. 2. It is big.) goes on.", "End"],
    ["Er kam am 3. Mai.", "Der 4. Lauf z. B. war gut.", "Es waren 12.", "Danach ging er."],
    ["Η ερώτηση είναι αυτή;", "Ναι.", "Τέλος"],
    ["«Да. Нет», — сказал он.", "К 2007 г. осталось 23 тыс. страниц.", "Конец."],
    ["हाँ।", "डॉ. राम आए।"],
    ["مرحبا.", "«كيف؟» سأل د. كريم.", "جيد."],
    ["« Non. Surtout pas », répond A. Nom.", "Quel gain !", "M. Nom a relu."],
    ["pVeza-5 starts in lower case.", "v9.9 too.", "\"안 된다. 절대로.\"라고 A. Kim이 적었다.", "놀랍다!"],
]
GLUED = [
    ["今天很好。", "我们去吧！", "“你好。”他说。", "他写道：“结束。”", "然后走了……", "第3页的观点.", "如Sec. 18所述，A. Kide et al.（2019）认为不对。[7]", "（仅此而已。）", "这样"],
    ["これはペンです。", "「はい。」と言った。", "A. Abe（2019年）は「近い。」と述べた。", "終わり．", "次"],
]


@pytest.mark.parametrize("case", CASES)
def test_spaced(case):
    text = " ".join(case)
    assert [text[a:b] for a, b in S.sentences(text)] == case
    wrapped = " ".join(case).replace(" ", "\n", 1)
    assert [wrapped[a:b].replace("\n", " ") for a, b in S.sentences(wrapped)] == case


@pytest.mark.parametrize("case", GLUED)
def test_without_spaces(case):
    text = "".join(case)
    assert [text[a:b] for a, b in S.sentences(text)] == case


def test_lines():
    text = "Heading\n\nOne line\nbroken. Two.\n1. First item\n2. Second item.\n- third\n• fourth \n \nLast"
    assert [text[a:b] for a, b in S.sentences(text)] == ["Heading", "One line\nbroken.", "Two.", "1. First item", "2. Second item.", "- third", "• fourth", "Last"]
    text = "Readers miss the point of Ex.\n9. Next."
    assert [text[a:b] for a, b in S.sentences(text)] == ["Readers miss the point of Ex.\n9.", "Next."]
    text = "ไปไหน มาไหน abc ไป"
    assert [text[a:b] for a, b in S.sentences(text)] == ["ไปไหน", "มาไหน abc ไป"]


def test_long_and_deep_quotations_are_one_sentence():
    inner = "One thing happened. Another followed it. " * 60
    for case in ([f"She said, “{inner}” and left.", "Then it ended."], [f"A note ({inner}) stands here.", "Then it ended."], ["So (a [b {c “d. E” f. G} h. I] j. K) it goes.", "Then it ended."], ["So (a (b (c (d) e) f) g. More here) it goes.", "Then it ended."], ["A ( stays open.", "Then (as said) it goes on.", "End."]):
        text = " ".join(case)
        for size in (60, S.CHUNK):
            assert [text[a:b] for a, b in S.sentences(text, size)] == case


def test_many_openers_take_linear_time():
    for text in ("Then ( we go “on [and on. " * 20_000, "Then (we go on. " * 20_000 + ")"):
        began = time.process_time()
        S.sentences(text)
        assert time.process_time() - began < 20


def test_every_character_once_and_chunks_change_nothing():
    rnd = random.Random(5)
    pieces = [s for c in CASES + GLUED for s in c] + ["\n\n", "\n", "1. ", "\n- ", "\"", "(", ")", "“", "」", "...", " ", "words that go on and on without any mark for a while "]
    for _ in range(60):
        text = "".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(60))
        found = S.sentences(text)
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in found)
        assert all(p[1] <= q[0] for p, q in zip(found, found[1:]))
        assert "".join("".join(text[a:b].split()) for a, b in found) == "".join(text.split())
        for size in (60, 200):
            assert S.sentences(text, size) == found


def test_chunks_are_functions_over_all_states():
    text = "He said \"words that go on. And more words\" and left. Nobody knew why (it is so. Really.) and so on. " * 6
    functions = []
    for lo, hi, a, b, pairs in S.cut_chunks(text, 80):
        places, kinds = S.chunk_symbols(text[a:b], lo, hi, a, pairs, False)
        after, masks = S.chunk_function(kinds)
        functions.append(after)
        for state in S.STATES:  # each state's run through the table
            end = state
            for kind in kinds:
                end = S.NEXT[end, kind]
            assert after[state] == end
            assert S.run_table(places, kinds, state) == [at for at, m in zip(places, masks.tolist()) if m >> state & 1]
    assert len(functions) > 5
    all_of = S.scan(np.array(functions))
    left = functions[0]
    for f, composed in zip(functions[1:], all_of[1:]):
        left = f[left]
        assert left.tolist() == composed.tolist()


@pytest.mark.parametrize("unit", ["今天很好。我们去吧！“你好。”他说。", "ไปไหน มาไหน ไปเถอะ ", "He came. We saw. (It is. So.) Go! ", "x" * 40 + ". Y (a [b. c] d. "])
def test_cut_anywhere_in_any_script(unit):
    text = unit * 400
    assert len(S.cut_chunks(text, 500)) > 8
    assert S.sentences(text, 500) == S.sentences(text, len(text))


def test_a_long_document_spreads_over_tasks(spark, tmp_path):
    text = "今天很好。我们去吧！“你好。他说。”如此。" * 20_000 + "End. (not. closed"
    pd.DataFrame({"doc_id": [7, 7, 8], "text": [text, text, "Short. One."]}).to_parquet(tmp_path / "t.parquet")
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    chunks = df.filter("doc_id = 7").limit(1).mapInArrow(S._to_chunks(S.CHUNK), f"id bigint, {S.CHUNK_ROW}").repartition(4, "doc", "chunk")
    rows = chunks.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 4 and sum(r["count"] for r in rows) == len(S.cut_chunks(text, S.CHUNK)) > 8
    got = sorted((r.doc_id, r.start_at, r.end_at) for r in S.split_sentences(df).collect())
    want = [(7, a, b) for a, b in S.sentences(text, len(text)) for _ in range(2)] + [(8, a, b) for a, b in S.sentences("Short. One.")]
    assert got == want


def test_table(spark):
    rows = [(1, "One. Two."), (2, ""), (3, None), (4, " \n"), (5, "x" * 100_000 + ". Y."), (1, "One. Two."), (None, "Z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start_at", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.start_at, r.end_at) for r in S.split_sentences(df).collect()))
    assert got == [(0, 0, 1), (1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (5, 0, 100_001), (5, 100_002, 100_004)]
    assert S.split_sentences(df.limit(0)).count() == 0
