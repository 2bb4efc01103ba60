from pyspark.sql import functions as F

from paperloom.operators import rows as R


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_latest_and_upsert(spark):
    a = frame(spark, [(1, 1, "x"), (1, 2, "y"), (None, 1, "n"), (2, None, "z"), (1, 2, "w")], "k int, v int, s string")
    got = {(r.k, r.v, r.s) for r in R.latest_per_key(a, ["k"], ["v"]).collect()}
    assert got == {(1, 2, "y"), (None, 1, "n"), (2, None, "z")}
    up = R.upsert(a, frame(spark, [(2, 5, "new")], "k int, v int, s string"), ["k"], ["v"])
    assert (2, 5, "new") in {tuple(r) for r in up.collect()}
    assert R.latest_per_key(a.limit(0), ["k"], ["v"]).count() == 0


def test_insert_ignore_and_compare_and_set(spark):
    base = frame(spark, [(1, 0, "a"), (2, 3, "b")], "k int, v int, s string")
    new = frame(spark, [(2, 9, "no"), (3, 1, "c"), (3, 0, "d")], "k int, v int, s string")
    assert {tuple(r) for r in R.insert_ignore(base, new, ["k"]).collect()} == {(1, 0, "a"), (2, 3, "b"), (3, 0, "d")}
    changed = R.compare_and_set(base, frame(spark, [(1, 0, "A"), (2, 2, "B")], "k int, v int, s string"), "k", "v", ["s"])
    assert {tuple(r) for r in changed.collect()} == {(1, 1, "A"), (2, 3, "b")}


def test_links_managed_backfill_and_retention(spark):
    old = frame(spark, [(1, 0, "a"), (2, 0, "b")], "o int, position int, t string")
    wanted = frame(spark, [(1, ["x", "y", "x"])], "o int, ts array<string>")
    assert {tuple(r) for r in R.replace_links(old, wanted, "o", "ts", "t").collect()} == {(1, 0, "x"), (1, 1, "y"), (2, 0, "b")}
    a, b = frame(spark, [(1, "s", "u")], "k int, m string, f string"), frame(spark, [(1, "other", "new"), (2, "mine", "x")], "k int, m string, f string")
    assert {tuple(r) for r in R.keep_managed(a, b, "k", ["m"]).collect()} == {(1, "s", "new"), (2, "mine", "x")}
    assert {tuple(r) for r in R.backfill(frame(spark, [(1, None), (2, "k")], "k int, m string"), a.select("k", "m"), "k", ["m"]).collect()} == {(1, "s"), (2, "k")}
    t = frame(spark, [(1, 5), (2, None), (3, 9)], "k int, d int")
    assert {r.k for r in R.keep_since(t, "d", F.lit(6)).collect()} == {2, 3}


def test_pages(spark):
    df = frame(spark, [(i, i % 3) for i in range(10)], "id int, v int")
    order = [F.col("v").desc(), F.col("id").desc()]
    everything = [r.id for r in df.orderBy(*order).collect()]
    assert [r.id for r in R.page(df, order, 2, 4).collect()] == everything[4:8]
    assert [r.id for r in R.page(df, order, -5, 0).collect()] == everything[:1]
    seen, last = [], None
    while got := R.after_key(df, "v", "id", last, 3).collect():
        seen += [r.id for r in got]
        last = (got[-1].v, got[-1].id)
    assert seen == everything
    assert R.top_k(df, ["v"], [F.col("id").asc()], 2).count() == 6


def test_violations_and_comparison(spark):
    df = frame(spark, [(1, "a"), (2, None), (3, "toolong")], "id int, s string")
    got = {(r.id, r.violation) for r in R.violations(df, "id", {"null": F.col("s").isNull(), "long": F.length("s") > 3}).collect()}
    assert got == {(2, "null"), (3, "long")}
    assert tuple(R.full_comparison(df, df.filter("id > 1").unionByName(frame(spark, [(9, "x")], "id int, s string")), "id").first()) == (1, 1, 2)
    assert df.select(R.first_text("s").alias("x")).filter("x is null").count() == 1
