import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import packing as K
from paperloom.llm import tokens as T

PATH = T.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
TEXTS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aest '\n0.中é")), max_size=60)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_equals_the_merges(reference, encoder, text):
    assert encoder.encode(text) == reference.encode_ordinary(text) and encoder.count(text) == len(encoder.encode(text))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_batches(reference, encoder, texts):
    got = [[i for piece in parts for i in piece] for parts in encoder.batch([*texts, None])]
    assert got == [*[reference.encode_ordinary(t) for t in texts], []]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=10), st.integers(0, 40), st.integers(0, 40))
def test_every_prefix_appends_and_edits(encoder, data, more, a, b):
    start, stop = sorted((min(a, len(data)), min(b, len(data))))
    v = encoder.vocabulary
    p = T.Prefixes(v, data).append(more)
    assert [p.ids(i) for i in range(len(p.data) + 1)] == [[v.ranks[t] for t in v.merged(p.data[:i])] for i in range(len(p.data) + 1)]
    assert p.replace(start, stop, more).ids() == [v.ranks[t] for t in v.merged(data[:start] + more + data[stop:] + more)]


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS, TEXTS, st.integers(0, 60), st.integers(0, 60))
def test_documents_append_and_edit(encoder, text, more, by, a, b):
    doc = T.Document(encoder, text).append(more)
    assert doc.ids() == encoder.encode(text + more)
    start, stop = sorted((min(a, len(doc.text)), min(b, len(doc.text))))
    want = doc.text[:start] + by + doc.text[stop:]
    doc.replace(start, stop, by)
    assert doc.text == want and doc.ids() == encoder.encode(want)


def test_table(spark, reference):
    rows = [(1, "a <|endoftext|> b"), (2, ""), (3, None), (None, "x"), (5, "中" * 3000), (5, "中" * 3000), (6, " \n\t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.ids) for r in T.encode_texts(df).collect()), key=str)
    assert got == sorted(((i is None, i or 0, reference.encode_ordinary(t or "")) for i, t in rows), key=str)
    counts = {(r.doc_id, r.n_tokens) for r in T.count_tokens(df).collect()}
    assert (2, 0) in counts and (3, 0) in counts
    assert T.encode_texts(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_packing_is_sound(sizes):
    bins = K.pack(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= len(K.best_fit(sizes, 50)) and len(bins) >= -(-sum(sizes) // 50)


def test_search_empties_bins():
    sizes = [6, 6, 4, 4, 3, 3, 2, 2]
    bins = [[0, 4], [1, 5], [2, 3], [6, 7]]
    assert len(K.empty_bins(bins, sizes, 10)) == 3


def test_containers(spark):
    rows = [(1, 25), (2, 7), (2, 7), (3, 0), (4, None), (5, 3), (6, 10), (None, 4)] + [(100 + i, 1 + i % 9) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint").withColumn("size", F.lit(9))
    out = K.fill_containers(df, "doc_id", "n", 10, group=40).collect()
    fills, items = {}, {}
    for r in out:
        fills[r.container_id] = fills.get(r.container_id, 0) + r["size"]
        items.setdefault(r.doc_id, []).append((r.piece_no, r.start_at, r["size"]))
    assert max(fills.values()) <= 10
    assert sorted(items[1]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and items[2] == [(0, 0, 7), (0, 0, 7)] and 3 not in items and 4 not in items
    total = sum(n for _, n in rows if n)
    assert sum(fills.values()) == total and len(fills) <= -(-total // 10) + 9  # one a group
    assert K.fill_containers(df.limit(0), "doc_id", "n", 10).count() == 0


def test_both_cuts_agree():
    own = T.encoder(T.vocabulary_path())
    rnd = random.Random(9)
    alphabet = "ab'st  \n\t\x0b\x1c\x85\xa0 中文ไทยé́٣①²ⅷ—·!﻿​<|endoftext|>1290"
    for _ in range(300):
        text = "".join(rnd.choice(alphabet) for _ in range(60))
        assert own.plain.findall(text) == own.cut.findall(text)
        assert own.pieces(text + "𝒙") == own.cut.findall(text + "𝒙")
    for code in (*range(0x300), *range(0x2000, 0x2100), *range(0xFB00, 0xFE00, 7)):
        text = f"a{chr(code)}1 {chr(code)}{chr(code)} b"
        assert own.plain.findall(text) == own.cut.findall(text)
