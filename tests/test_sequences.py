import random

from pyspark.sql import functions as F

from paperloom.operators.metrics import nearest_rank, precision_recall, ranking, term_groups
from paperloom.operators.sequences import islands, lag_values, number_rows, scan_groups


def order():
    return [F.col("t").asc_nulls_last(), F.col("id").asc()]


def data(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([None, *range(50)]), rnd.choice([None, 1, 2, 3])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, k string, t int, v int")


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_running_values_over_blocks(spark):
    rows, df = data(spark)
    out = scan_groups(df, ["k"], order(), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v")), "l": ("last", F.col("v"))}, block=7)
    got = {r.id: (r.s, r.m, r.n, r.l) for r in out.collect()}
    assert len(got) == len(rows)
    for g in groups(rows).values():
        seen = []
        for r in g:
            known = [v for v in seen if v is not None]
            assert got[r[0]] == ((sum(known), max(known), min(known), known[-1]) if known else (None,) * 4)
            seen.append(r[3])


def test_numbers_lags_islands(spark):
    rows, df = data(spark, 120, 2)
    no = {r.id: r.no for r in number_rows(df, ["k"], order()).collect()}
    lag = {r.id: r.before for r in lag_values(df, ["k"], order(), {"before": "v"}).collect()}
    isl = {r.id: r.island for r in islands(df, ["k"], order(), F.col("v") == 1).collect()}
    for g in groups(rows).values():
        island, before = 0, None
        for i, r in enumerate(g):
            island += r[3] == 1
            assert (no[r[0]], lag[r[0]], isl[r[0]]) == (i + 1, before, island)
            before = r[3]


def test_empty(spark):
    _, df = data(spark, 5)
    assert number_rows(df.limit(0), ["k"], order()).count() == 0


def test_nearest_rank(spark):
    rows = [("a", float(i)) for i in range(1, 21)] + [("b", 5.0)] * 3 + [("c", None)]
    got = {r.k: (r.p50, r.p95) for r in nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (10.0, 19.0), "b": (5.0, 5.0)}


def test_labels_and_ranking(spark):
    cases = spark.createDataFrame([(["x", "y"], ["z"], ["x", "z", "w"]), (None, None, ["x"])], "r array<string>, a array<string>, p array<string>")
    got = {r.label: (r.tp, r.fp, r.fn) for r in precision_recall(cases, "r", "a", "p").collect()}
    assert got == {"x": (1, 1, 0), "y": (0, 0, 1), "w": (0, 1, 0)}
    hits = spark.createDataFrame([("n1", 1, False), ("n1", 2, True), ("n2", 5, True), ("n3", 1, False)], "n string, k int, ok boolean")
    r = ranking(hits, "n", "k", "ok", 4).first()
    assert (r.needs, r.recall_at_k, r.mrr) == (3, round(1 / 3, 6), round((0.5 + 0.2) / 3, 6))
    df = spark.createDataFrame([("Glyph and BOX",), ("glyph",), ("",)], "t string")
    hit = term_groups(F.col("t"), F.array(F.array(F.lit("glyph")), F.array(F.lit("box"), F.lit("tree"))))
    assert [r.h for r in df.select(hit.alias("h")).collect()] == [True, False, False]
