"""The search keeps k sources a need in every task: its rows are those of all pairs, which are never shuffled."""

import os
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest

from paperloom.operators import ranking
from paperloom.operators import retrieval as Q
from paperloom.plans import registry

FOLDER = "/root/testdata/sf0.01"
#: Rows that a query may shuffle.
LIMIT = dict.fromkeys("ret_search ret_metrics ret_typed ret_targets ret_selected ret_labels ret_second_page".split(), 4_000)
TOKEN = re.compile(r"[a-z0-9_-]+")


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def brute(need, types, first, last, sources, k):
    """(source_id, score, routes) by comparing the need with every source."""
    out = []
    tokens = lambda t: list(dict.fromkeys(x for x in TOKEN.findall(t) if len(x) > 1))
    compact = lambda t: "".join(c for c in t if c.isalnum())
    q = " ".join(need.lower().split())
    asked, cq = tokens(q), compact(q)
    numbers = re.findall(r"\((\d{1,4})\)", q)
    for sid, page, kind, text, section in sources:
        t = " ".join(f"{text} {section}".lower().split())
        formula = kind == "FORMULA" and bool(set(numbers) & set(re.findall(r"\((\d{1,4})\)", text)))
        if types and (kind not in types or numbers and "FORMULA" in types and not formula) or page is not None and not (first or -9) <= page <= (last or 99):
            continue

        def cover(side):
            c = compact(side)
            if not cq or not c:
                return 0
            if cq in c:
                return 1
            if not asked or not tokens(side):
                return min(1.0, len(os.path.commonprefix([cq, c])) / max(4, len(cq)))
            return len(set(asked) & set(tokens(side))) / len(asked)

        lexical, there, phrase = cover(t), cover(section.lower()), bool(q) and q in t
        score = min(1.0, max(0.72 * lexical, 0.96 * phrase, 1.0 * formula, 0.35 + 0.55 * there if there else 0))
        score = float(Decimal(repr(float(score))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
        routes = [*(["EXACT_PHRASE"] if phrase else ["TOKEN_COVERAGE"] if lexical else []), *["FORMULA_NUMBER"] * formula, *["SECTION"] * (there > 0)]
        if q and score > 0:
            out.append(((-score, page is None, page or 0, sid), (sid, score, "+".join(routes))))
    return [x for _, x in sorted(out)[:k]]


def made(seed: int = 3, needs: int = 150, sources: int = 260):
    r = random.Random(seed)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "b", "-", "--", "(7)", "(12)", "é", "ж", "жук", "жа", "aab"]
    some = lambda n: " ".join(r.choices(words, k=r.randint(0, n)))
    rows = [(f"s{i}", r.choice([None, 1, 2, 3]), r.choice(["TEXT", "FORMULA", "TABLE"]), some(9), some(2)) for i in range(sources)]
    return [(f"n{i}", some(3), r.choice([None, [], ["TEXT"], ["FORMULA", "TABLE"]]), r.choice([None, 2]), r.choice([None, 2, 3])) for i in range(needs)], rows


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 24)
    monkeypatch.setattr(ranking, "DENSE", 4)


def matched(requests, rows, k):
    """What the Arrow function keeps, in one task: it needs no session."""
    import pyarrow as pa

    tokens = lambda t: list(dict.fromkeys(x for x in TOKEN.findall(t) if len(x) > 1))
    compact = lambda t: "".join(c for c in t if c.isalnum())
    numbers = lambda t: re.findall(r"\((\d{1,4})\)", t)
    clean = lambda t: " ".join(t.lower().split())
    lists = pa.list_(pa.string())
    req = [{"req": i, "q": clean(q), "types": t, "first_page": a, "last_page": b, "tokens": tokens(clean(q)), "cq": compact(clean(q)), "q_formulas": numbers(q), "q_figures": []} for i, (_, q, t, a, b) in enumerate(requests) if clean(q)]
    asked = pa.Table.from_pylist(req, schema=pa.schema({"req": pa.int64(), "q": pa.string(), "types": lists, "first_page": pa.int32(), "last_page": pa.int32(), "tokens": lists, "cq": pa.string(), "q_formulas": lists, "q_figures": lists}))
    src = [{"source_id": i, "page": p, "kind": kind, "t": (t := clean(f"{x} {s}")), "ct": compact(t), "cs": compact(s), "t_tokens": tokens(t), "s_tokens": tokens(s), "formulas": numbers(x) if kind == "FORMULA" else [], "figures": []} for i, p, kind, x, s in rows]
    schema = pa.schema({"source_id": pa.string(), "page": pa.int32(), "kind": pa.string(), "t": pa.string(), "ct": pa.string(), "cs": pa.string(), "t_tokens": lists, "s_tokens": lists, "formulas": lists, "figures": lists})
    matcher = ranking.Matcher(asked, k)
    for batch in pa.Table.from_pylist(src, schema=schema).to_batches(max_chunksize=50):
        matcher.feed(batch)
    out = pa.schema({"req": pa.int64(), "source_id": pa.string(), "page": pa.int32(), "score": pa.float64(), "routes": pa.int32()})
    return [x for b in matcher.rows(out) for x in b.to_pylist()]


def named(bits):
    return "+".join([*(["EXACT_PHRASE"] if bits & 1 else ["TOKEN_COVERAGE"] if bits & 2 else []), *["FORMULA_NUMBER"] * bool(bits & 4), *["SECTION"] * bool(bits & 16)])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("k", [1, 4, 300])
def test_matcher_gives_the_best_of_all_pairs(small_chunks, seed, k):
    needs, rows = made(seed)
    got = matched(needs, rows, k)
    for i, (_, *need) in enumerate(needs):
        assert [(x["source_id"], x["score"], named(x["routes"])) for x in got if x["req"] == i] == brute(*need, rows, k), need


def test_search_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_REQUESTS", 40)
    needs, rows = made(9, 70, 90)
    needs = [x for x in needs if "é" not in x[1]]  # é is a letter of tokens to the engine, but not to this test
    rows = [x for x in rows if "é" not in x[3] + x[4]]
    n = spark.createDataFrame(needs, "need_id string, query string, types array<string>, first_page int, last_page int")
    s = spark.createDataFrame(rows, "source_id string, page int, kind string, text string, section string")
    got = {}
    for r in sorted(Q.search(n, s, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.need_id, []).append((r.source_id, r.score, r.routes))
    for i, *need in needs:
        assert got.get(i, []) == brute(*need, rows, 5), need


def test_marks_alone_are_no_coverage(spark):
    """A need of marks has no letters or digits to be covered, though its marks may make a token; the phrase counts."""
    n = spark.createDataFrame([("n", "--"), ("m", "-- --")], "need_id string, query string")
    s = spark.createDataFrame([("a", 1, "TEXT", "x -- y", "")], "source_id string, page int, kind string, text string, section string")
    assert [tuple(r) for r in Q.search(n, s).collect()] == [("n", "a", 0.96, "EXACT_PHRASE", 1)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", LIMIT)
def test_pairs_are_not_shuffled(spark, name):
    before = shuffled(spark)
    registry.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < LIMIT[name]


@pytest.mark.parametrize("shared", [2, 1000])
@pytest.mark.parametrize("expanded", [5, 1 << 20])
def test_groups_and_own_rows_give_the_best_of_all_pairs(small_chunks, monkeypatch, shared, expanded):
    monkeypatch.setattr(ranking, "SHARED", shared)
    monkeypatch.setattr(ranking, "EXPANDED", expanded)
    needs, rows = made(11)
    got = matched(needs, rows, 4)
    for i, (_, *need) in enumerate(needs):
        assert [(x["source_id"], x["score"], named(x["routes"])) for x in got if x["req"] == i] == brute(*need, rows, 4), need
