import random

from pyspark.sql import functions as F

from paperloom.llm import spellings as S


def test_distance():
    for a, b in (("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("abc", "xabc"), ("abc", "acb")):
        assert S.distance_one(a, b) and S.distance_one(b, a) and S.deletions(a, 1) & S.deletions(b, 1)
    assert not S.distance_one("abc", "cab") and not S.distance_one("abcd", "badc")


def test_readings():
    assert S.author_readings("Dr. José de la Cruz")[0][:3] == ("jose", "", "delacruz")
    assert S.author_readings("de la Cruz, José")[0][:3] == S.author_readings("Cruz, José de la")[0][:3] == ("jose", "", "delacruz")
    assert S.author_readings("J. Cruz")[0][:3] == S.author_readings("Cruz J")[0][:3] == ("j", "", "cruz")
    assert S.author_readings("Philip E. Tunet")[0][:3] == ("philip", "e", "tunet")
    assert S.author_readings("Cruz") == [] and S.author_readings("") == []


def test_venues():
    words = S.venue_words
    assert words("Figure Mining, Journal of") == words("The Journal of Figure Mining (JFM)") == words("journal  of figure mining.") == ["journal", "figure", "mining"]
    assert words("Proceedings of the Symposium on Figure Mining") == words("Symposium on Figure Mining")
    assert S.venue_likelihood(words("Jnl. of Fig. Mini."), words("Journal of Figure Mining"))[1]
    assert S.venue_likelihood(words("JFM"), words("Journal of Figure Mining"))[0] > 0
    assert S.venue_likelihood(words("Workshop on Figure Mining"), words("Journal of Figure Mining"))[0] == 0


def papers(spark, rows):
    return spark.createDataFrame(rows, "authors string, source string").withColumn("name", F.lit("clash"))


def test_entries(spark):
    df = papers(spark, [("A B; C, D ;", None), ("A B, C D and E F & G H", None), ("Andy Sand, X", None), ("", None), (None, None), (" ; ", "")])
    assert sorted(r.name for r in S.author_entries(df).collect()) == sorted(["A B", "C, D", "A B", "C D", "E F", "G H", "Andy Sand", "X"])


def test_pairs(spark):
    rows = [("Jonathan Vumavoke", "Journal of Figure Mining")] * 9 + [("Mirela Vumavoke", "Workshop on Figure Mining")] * 9
    rows += [("Jon Vumavoke", "JFM"), ("Vumavoke, J.;", "Jnl. of Figure Mining"), ("Jonathan Vumavkoe", "journal of figure mining"), ("VUMAVOKE Jonathan", "preprint"), ("M. Vumavoke", None), ("Jonathan Vumavoke", ""), (None, None)]
    forms = spark.createDataFrame([("Jon", "Jonathan")], "short_form string, full_form string")
    got = {(r.kind, r.name_a, r.name_b) for r in S.spelling_pairs(papers(spark, rows), forms).collect()}
    one = ["Jonathan Vumavoke", "Jon Vumavoke", "Vumavoke, J.", "Jonathan Vumavkoe", "VUMAVOKE Jonathan", "Jonathan Vumavoke"]
    two = ["Mirela Vumavoke", "M. Vumavoke"]
    venue = ["Journal of Figure Mining", "JFM", "Jnl. of Figure Mining", "journal of figure mining"]
    want = {(k, a, b) for k, own in (("author", one), ("author", two), ("source", venue)) for a in own for b in own if a < b}
    assert got == want


def test_ambiguous_initials_stay_apart(spark):
    rows = [("James Vumavoke", None)] * 5 + [("Joseph Vumavoke", None)] * 5 + [("J. Vumavoke", None)]
    rows += [("Jack Vumavoke", None)] * 5
    forms = spark.createDataFrame([], "short_form string, full_form string")
    assert S.spelling_pairs(papers(spark, rows), forms).count() == 0
    assert S.spelling_pairs(papers(spark, rows).limit(0), forms).count() == 0


def test_nicknames_are_learned_from_wide_surnames(spark):
    rows = [("author", f"filler{s}x{i}||{s}", 1) for s in ("aa", "bb", "cc") for i in range(70)]
    rows += [("author", f"{g}||{s}", n) for s in ("aa", "bb", "cc") for g, n in (("robert", 100), ("bob", 5), ("maria", 6))]
    got = S.learned_nicknames(spark.createDataFrame(rows, "kind string, form string, n bigint"))
    assert {(r.short, r.full) for r in got.collect()} == {("bob", "robert"), ("maria", "robert")}


def test_short_names_and_long_acronyms_have_keys():
    wang, wagn = S.author_readings("Mary Wang"), S.author_readings("Mary Wagn")
    assert S.author_keys(wagn, {})[0] & S.author_keys(wang, {})[1] and S.author_likelihood(wagn, wang[0], {})[0] > 0
    ana, anx = S.author_readings("Ana Petrova"), S.author_readings("Anx Petrova")
    assert S.author_keys(anx, {})[0] & S.author_keys(ana, {})[1]
    full = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu"
    initials = "".join(w[0] for w in full.split())
    assert S.venue_keys(S.venue_words(initials))[0] & S.venue_keys(S.venue_words(full))[1]
    assert S.venue_likelihood(S.venue_words(initials), S.venue_words(full))[0] > 0


def test_nicknames_are_learned_as_if_all_pairs_were_counted(spark):
    rnd = random.Random(2)
    surnames = [f"s{i}" for i in range(30)]
    rows = [(f"{g}||{s}", rnd.randint(1, 3) if g.startswith("short") else rnd.randint(30, 60)) for g in ("shorta", "shortb", "fulla", "fullb", "fullc") for s in surnames if rnd.random() < (0.3 if g.startswith("short") else 0.8)]
    df = spark.createDataFrame([("author", f, n, f) for f, n in rows], "kind string, form string, n bigint, sample string")
    by: dict = {}
    for f, n in rows:
        g, _, s = f.split("|")
        by.setdefault(g, {})[s] = n
    want = set()
    for g, own in by.items():
        for full, other in by.items():
            together = sum(other.get(s, 0) > n for s, n in own.items())
            if len(own) >= 2 and sum(own.values()) * S.RARER < sum(other.values()) * 4:
                often = together >= S.LEARN_SURNAMES and together >= S.LEARN_SHARE * len(own)
                if often or together == len(own) >= 2 and g[0] == full[0]:
                    want.add((g, full))
    assert want and {(r.short, r.full) for r in S.learned_nicknames(df).collect()} == want
