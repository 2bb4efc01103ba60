from datetime import date, datetime

from pyspark.sql import functions as F

from paperloom.operators import retrieval as Q
from paperloom.pipeline import Step, Workflow, names, transform
from paperloom.sources import files as FS
from paperloom.sources import records as S
from paperloom.streaming import events as E


def test_lines_upsert(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"caseId":"1","v":1}\n\nnot json\n{"caseId":"2","v":2}\n')
    (tmp_path / "b.jsonl").write_text('{"caseId":"2","v":20}\n{"v":0}\n')
    old, new = (S.read_lines(spark, str(tmp_path / f), "caseId") for f in ("a.jsonl", "b.jsonl"))
    got = {(r.key, r.line, r.damaged) for r in S.upsert_lines(old, new).collect()}
    assert ("2", '{"caseId":"2","v":20}', False) in got and (None, "not json", True) in got and (None, '{"v":0}', False) in got and len(got) == 4


def test_atom_and_works(spark):
    xml = "<feed><entry><id>http://x.example/abs/2101.1v2</id><title>A\n b</title><summary>s</summary><author><name>N. One</name></author><author><name>Two</name></author><published>2020-02-03T00:00:00Z</published></entry></feed>"
    r = S.parse_atom(spark.createDataFrame([(1, xml), (2, None), (3, "junk")], "id int, x string"), "id", "x").collect()
    assert len(r) == 1 and (r[0].entry_id, r[0].title, r[0].authors, r[0].published, r[0].doi) == ("2101.1", "A b", ["N. One", "Two"], date(2020, 2, 3), None)
    work = '{"message":{"title":["T <i>x</i>"],"container-title":["V"],"DOI":"10.1/A","author":[{"given":"G","family":"F"},{"name":"Org"}],"issued":{"date-parts":[[2019,1]]},"published-online":{"date-parts":[[2018]]}}}'
    w = S.parse_works(spark.createDataFrame([(1, work), (2, "{")], "id int, j string"), "id", "j").orderBy("id").collect()
    assert (w[0].title, w[0].source, w[0].doi, w[0].authors, w[0].year) == ("T x", "V", "10.1/a", "G F; Org", 2018) and w[1].title is None


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"one")
    (tmp_path / "c.bin").write_bytes(b"")
    f = FS.read_files(spark, str(tmp_path))
    assert f.count() == 2 and f.select("fingerprint").distinct().count() == 1
    same = {r.path.split("/")[-1]: r.same_as for r in FS.same_files(f, f.filter("path like '%b.bin'")).collect()}
    assert same["a.bin"].endswith("b.bin") and set(same) == {"a.bin", "b.bin"}
    df = spark.createDataFrame([(0, 1, False), (9, 0, True), (9, 2, None)], "n bigint, p int, e boolean")
    assert [r.x for r in df.select(FS.file_problems(F.col("n"), F.col("p"), F.col("e")).alias("x")).collect()] == [["EMPTY"], ["ENCRYPTED", "NO_PAGES"], []]
    parts = spark.createDataFrame([(1, 2, "row", None, ["a ", None]), (1, 1, "paragraph", " p ", None), (1, 3, "paragraph", "", None)], "id int, pos int, kind string, text string, cells array<string>")
    assert FS.word_text(parts, "id").first().text == "p\na | "
    assert FS.useful_images(spark.createDataFrame([(100, 100), (99, 500)], "width int, height int")).count() == 1


def test_search_and_selection(spark):
    sources = spark.createDataFrame(
        [("s1", 1, "TEXT", "the glyph box drifts", "Intro"), ("s2", 2, "FIGURE", "Fig. 3 shows glyph runs", ""), ("s3", 3, "TEXT", "nothing", "glyph box"), ("s4", 1, "TEXT", "", "")], "source_id string, page int, kind string, text string, section string"
    )
    needs = spark.createDataFrame([("n1", "Glyph box"), ("n2", "fig. 3"), ("n3", ""), ("n4", None), ("n5", "absent words")], "need_id string, query string")
    got = [(r.need_id, r.source_id, r.score, r["rank"]) for r in Q.search(needs, sources).orderBy("need_id", "rank").collect()]
    assert got == [("n1", "s1", 0.96, 1), ("n1", "s3", 0.96, 2), ("n1", "s2", 0.36, 3), ("n2", "s2", 1.0, 1)]
    hits = spark.createDataFrame([("g", "a", "x", 1), ("g", "a", "y", 2), ("g", "b", "x", 1), ("g", "b", "z", 2)], "g string, n string, s string, rank int")
    assert [(r.s, r.place) for r in Q.fair_selection(hits, "g", "n", "s", "rank", 2).orderBy("place").collect()] == [("x", 1), ("y", 2)]
    df = spark.createDataFrame([("é" * 100, "abc", "abd")], "t string, a string, b string")
    r = df.select(Q.fitting_length(F.col("t"), 120).alias("n"), F.round(Q.claim_similarity(F.col("a"), F.col("b")), 4).alias("s")).first()
    assert r.n == 56 and r.s == round(0.65 * 2 / 3 + 0.35 / 2, 4)
    found = Q.fill_missing(needs.select("need_id"), needs.filter("need_id = 'n1'"), needs, "need_id")
    assert found.count() == 5


def test_streams_match_batch_and_leases_expire(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i, base.replace(hour=i % 20, minute=i % 60), i % 3, "view", 1.0, "{}") for i in range(60)] + [(99, datetime(2024, 1, 5), 9, "view", 1.0, "{}")]
    spark.createDataFrame(rows, E.EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = E.event_stream(spark, str(tmp_path))
    got = {(r.start_at, r.events) for r in E.run_all(E.windowed(stream)).collect()}
    batch = spark.createDataFrame(rows, E.EVENTS).filter("event_id != 99").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").start.alias("s")).count()
    assert got == {(r.s, r["count"]) for r in batch.collect()}
    out = E.run_all(E.leases(E.event_stream(spark, str(tmp_path)))).collect()
    assert {(r.user_id, r.status, r.beats) for r in out} == {(0, "EXPIRED", 20), (1, "EXPIRED", 20), (2, "EXPIRED", 20)}
    assert E.run_all(E.first_deliveries(E.event_stream(spark, str(tmp_path)), ["user_id"])).count() == 4


def test_workflow_resumes(spark, tmp_path):
    runs = []

    @transform("numbers")
    def numbers(spark, results, upto):
        runs.append("numbers")
        return spark.range(int(upto))

    @transform("doubled")
    def doubled(spark, results):
        runs.append("doubled")
        return results["first"].selectExpr("id * 2 as id")

    w = Workflow(str(tmp_path / "w"), [Step("first", "numbers", {"upto": "{{n}}"}), Step("second", "doubled", waits=True)])
    assert w.run(spark, {"n": "3"}) == "second" and w.run(spark, {"n": "3"}, {"second"}) is None and w.run(spark) is None
    assert runs == ["numbers", "doubled"] and {"numbers", "doubled"} <= set(names())
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "w/second")).collect()) == [0, 2, 4]
