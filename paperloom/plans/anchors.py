"""Queries that anchor selections in layouts, continue texts over pages, and fill records from what texts say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import metadata as M
from paperloom.functions import text as T
from paperloom.operators import layout as L
from paperloom.session import table

# ---- Fixed values: weights and thresholds of anchors, and places of page breaks --------------------------------------
GEOMETRY, WORDS, FLOOR, OF_BEST, MOST = 0.78, 0.22, 0.28, 0.52, 12
AGREED_GEOMETRY, AGREED_WORDS, AGREED_CONFIDENCE = 0.58, 0.27, 0.15
FOOT, HEAD = 0.84, 0.16
#: Words of lines that name a venue, and characters of an abstract.
VENUE = r"(?m)^[^\n]*(?:Journal|Proceedings|Conference|Transactions|Letters|Symposium)[^\n]*$"
ABSTRACT = r"(?i)abstract[\s.:—-]*([^\n]{20,})"
ABSTRACT_LENGTH = 3000


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Valid blocks of all artifacts."""
    return L.layout_blocks(table(spark, folder, "paper_layout_artifact")).filter(G.valid(G.box()))


def anchored(selections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(selection_id, blocks, geometry, words, confidence, kind) of every selection that some block answers.

    selections: selection_id, artifact_id, page, sx, sy, sw, sh, phrase. A block's score is 0.78 of the share of the
    selection that it covers and 0.22 of the phrase's share that it has; blocks of at least 0.28 and 0.52 of the best
    answer, at most twelve, in reading order. ``kind``: EXACT if their texts have the whole phrase, PARTIAL if they cover
    half of the box or have half of the words, else REGION. Joined by page.
    """
    box = tuple(F.col(c) for c in ("sx", "sy", "sw", "sh"))
    tokens = T.tokens(F.col("phrase"))
    pairs = selections.join(blocks, ["artifact_id", "page"]).withColumn("covers", G.coverage(G.box(), box))
    scored = pairs.withColumn("score", F.round(GEOMETRY * F.col("covers") + WORDS * T.query_coverage(F.col("phrase"), tokens, F.col("text"), T.tokens(F.col("text"))), 6))
    w = Window.partitionBy("selection_id").orderBy(F.desc("score"), "ord", "block_id")
    ranked = scored.withColumn("r", F.row_number().over(w)).withColumn("best", F.max("score").over(Window.partitionBy("selection_id")))
    kept = ranked.filter((F.col("score") >= FLOOR) & (F.col("score") >= OF_BEST * F.col("best")) & (F.col("r") <= MOST))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", "text"))), lambda x: x["text"]), " ")
    g = kept.groupBy("selection_id", "phrase").agg(F.count("*").alias("blocks"), F.max("covers").alias("geometry"), F.avg("confidence").alias("sure"), text.alias("text"))
    g = g.withColumn("words", T.query_coverage(F.col("phrase"), tokens, F.col("text"), T.tokens(F.col("text"))))
    confidence = T.clamp(AGREED_GEOMETRY * F.col("geometry") + AGREED_WORDS * F.col("words") + AGREED_CONFIDENCE * F.col("sure"))
    kind = F.when(F.col("words") == 1.0, "EXACT").when((F.col("geometry") >= 0.5) | (F.col("words") >= 0.5), "PARTIAL").otherwise("REGION")
    return g.select("selection_id", "blocks", F.round("geometry", 6).alias("geometry"), F.round("words", 6).alias("words"), F.round(confidence, 6).alias("confidence"), kind.alias("kind"))


def doc_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Selections anchored: for every page, the box a little around its first block with the block's first 60 characters."""
    b = blocks(spark, folder)
    w = Window.partitionBy("artifact_id", "page").orderBy("ord", "block_id")
    first = b.withColumn("r", F.row_number().over(w)).filter("r = 1")
    s = first.select(F.concat_ws("-", "artifact_id", "page").alias("selection_id"), "artifact_id", "page", (F.col("x") - 0.01).alias("sx"), (F.col("y") - 0.01).alias("sy"), (F.col("w") + 0.02).alias("sw"), (F.col("h") + 0.05).alias("sh"), F.substring("text", 1, 60).alias("phrase"))
    return anchored(s, b)


def _continues(before: Column, after: Column) -> Column:
    """How a text goes on in the next: HYPHEN, LOWER, MARK, HAN; null if it doesn't."""
    first = F.substring(after, 1, 1)
    return (
        F.when((before == "") | (after == "") | T.ends_sentence(before) | after.rlike(r"^(?:[-•*]|\d{1,3}[.)]|\[\d)"), None)
        .when(before.rlike(r"[^-]-$") & first.rlike(r"\p{Ll}"), "HYPHEN")
        .when(first.rlike(r"\p{Ll}"), "LOWER")
        .when(first.rlike(r"[,;:)\]}]"), "MARK")
        .when(before.rlike(r"\p{IsHan}$") & first.rlike(r"\p{IsHan}"), "HAN")
    )


def doc_page_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that go on over a page or a column: edges from a block to the next of the same role and section, from the
    foot of one page or lane to the head of the next, with how it goes on."""
    b = blocks(spark, folder).filter("role in ('BODY', 'ABSTRACT') and trim(text) != ''").withColumn("lane", G.lane(F.col("page"), G.box()))
    w = Window.partitionBy("artifact_id").orderBy("ord", "block_id")
    p = b.withColumn("p", F.lag(F.struct("block_id", "page", "role", "section", "text", "lane", (F.col("y") + F.col("h")).alias("bottom"))).over(w)).filter("p.role = role and p.section = section")
    page = (F.col("page") == F.col("p.page") + 1) & (F.col("p.bottom") >= FOOT) & (F.col("y") <= HEAD)
    lane = (F.col("page") == F.col("p.page")) & (F.col("p.lane") == "LEFT") & (F.col("lane") == "RIGHT")
    how = _continues(F.rtrim("p.text"), F.ltrim("text"))
    return p.filter(page | lane).select("artifact_id", F.col("p.block_id").alias("from_id"), F.col("block_id").alias("to_id"), F.when(page, "PAGE").otherwise("COLUMN").alias("over"), how.alias("how")).filter("how is not null")


def lib_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Every paper's title, DOI, year and venue with where each comes from: the record, or else the first of its documents
    that says it; and the length of the abstract found."""
    t = F.coalesce("text", F.lit(""))
    line = F.trim(F.regexp_extract(t, r"^\s*([^\n]{8,200})", 1))
    said = {"title": line, "doi": M.find_doi(t), "year": F.coalesce(M.find_year(t).cast("string"), F.lit("")), "venue": F.trim(F.regexp_extract(t, VENUE, 0)), "abstract": F.substring(F.regexp_extract(t, ABSTRACT, 1), 1, ABSTRACT_LENGTH)}
    d = table(spark, folder, "documents").filter("paper_id is not null and doc_id is not null").select("paper_id", "doc_id", *[c.alias(n) for n, c in said.items()])
    found = d.groupBy("paper_id").agg(*[F.min_by(n, F.when(F.col(n) != "", F.col("doc_id"))).alias(f"f_{n}") for n in said])
    p = table(spark, folder, "paper").select("id", M.clean_title(F.col("title")).alias("title"), M.bare_doi(F.col("doi")).alias("doi"), F.when(F.col("year").between(1900, 2099), F.col("year").cast("string")).alias("year"), M.clean_title(F.col("source")).alias("venue"))
    j = p.join(found, p.id == found.paper_id, "left")
    own = lambda n: F.when(F.coalesce(F.col(n), F.lit("")) != "", F.col(n))
    names = ("title", "doi", "year", "venue")
    origin = F.concat(*[F.when(own(n).isNotNull(), "r").when(F.coalesce(F.col(f"f_{n}"), F.lit("")) != "", "t").otherwise("-") for n in names])
    return j.select("id", *[F.coalesce(own(n), F.col(f"f_{n}")).alias(n) for n in names], origin.alias("origin"), F.coalesce(F.length("f_abstract"), F.lit(0)).cast("bigint").alias("abstract"))


def txt_dois(spark: SparkSession, folder: str) -> DataFrame:
    """DOIs put together from fragments: labels and resolvers off, spaces inside out, closing marks off; and whether each is
    whole (a registrant and a suffix of three characters)."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce("doi", F.lit("")), r"\s+", "")), r"^(?:https?://[^/]+/|doi:)+", "")
    doi = F.regexp_replace(bare, r"[.,;:)\]}]+$", "")
    return table(spark, folder, "paper").select("id", F.when(doi != "", doi).alias("doi"), doi.rlike(r"^10\.\d{4,9}/\S{3,}$").alias("whole"))


def queries() -> dict:
    """The queries of this module."""
    return {n: f for n, f in globals().items() if n.startswith(("doc_", "lib_", "txt_"))}


def oracle_sql() -> dict[str, str]:
    """DuckDB texts with the same results."""
    from paperloom.plans.documents import _B

    uni = T.sql_unified
    tok = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({uni(c)}), '[\\p{{Han}}]+|[\\p{{Latin}}\\p{{N}}_-]+|[\\p{{Greek}}\\p{{N}}]+'), lambda x: length(x) > 1))"
    com = lambda c: f"regexp_replace(lower({uni(c)}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"
    cover = lambda c: f"CASE WHEN pc = '' OR {c}c = '' THEN 0 WHEN contains({c}c, pc) THEN 1 ELSE coalesce(len(list_intersect(pk, {c}k)) / nullif(len(pk), 0), 0) END"
    doi = r"regexp_replace(lower(regexp_extract(t, '(10\.\d{4,9}/[^\s\"<>]+)', 1)), '[.,;:)\]}]+$', '')"
    title = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
    own = lambda n: f"CASE WHEN coalesce({n}, '') <> '' THEN {n} END"
    names = ("title", "doi", "year", "venue")
    return {
        "doc_anchors": f"""WITH {_B}, v AS (SELECT artifact_id, page, block_id, ord, text, confidence, x, y, w, h FROM boxed WHERE valid),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY artifact_id, page ORDER BY ord, block_id) = 1),
s AS (SELECT artifact_id || '-' || page AS selection_id, artifact_id, page, x - 0.01 AS sx, y - 0.01 AS sy, w + 0.02 AS sw, h + 0.05 AS sh, substr(text, 1, 60) AS phrase FROM f),
p AS (SELECT selection_id, phrase, block_id, ord, text, confidence, coalesce(greatest(least(x + w, sx + sw) - greatest(x, sx), 0) * greatest(least(y + h, sy + sh) - greatest(y, sy), 0) / nullif(greatest(sw, 0) * greatest(sh, 0), 0), 0) AS covers,
  {com('phrase')} AS pc, {tok('phrase')} AS pk, {com('text')} AS tc, {tok('text')} AS tk FROM s JOIN v USING (artifact_id, page)),
c AS (SELECT *, round(0.78 * covers + 0.22 * {cover('t')}, 6) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY score DESC, ord, block_id) AS r, max(score) OVER (PARTITION BY selection_id) AS best FROM c),
g AS (SELECT selection_id, any_value(pc) AS pc, any_value(pk) AS pk, count(*) AS blocks, max(covers) AS geometry, avg(confidence) AS sure, string_agg(text, ' ' ORDER BY ord, block_id) AS text FROM r WHERE score >= 0.28 AND score >= 0.52 * best AND r <= 12 GROUP BY selection_id),
h AS (SELECT *, {com('text')} AS tc, {tok('text')} AS tk FROM g), i AS (SELECT *, {cover('t')} AS words FROM h)
SELECT selection_id, blocks, round(geometry, 6) AS geometry, CAST(round(words, 6) AS DOUBLE) AS words, round(least(1, greatest(0, 0.58 * geometry + 0.27 * words + 0.15 * sure)), 6) AS confidence,
  CASE WHEN words = 1 THEN 'EXACT' WHEN geometry >= 0.5 OR words >= 0.5 THEN 'PARTIAL' ELSE 'REGION' END AS kind FROM i""",
        "doc_page_joins": f"""WITH {_B}, b AS (SELECT *, rtrim(lag(text) OVER o, ' ') AS before, ltrim(text, ' ') AS after, lag(block_id) OVER o AS p_id, lag(page) OVER o AS p_page, lag(role) OVER o AS p_role, lag(section) OVER o AS p_section, lag(lane) OVER o AS p_lane, lag(y + h) OVER o AS bottom
  FROM boxed WHERE valid AND role IN ('BODY', 'ABSTRACT') AND trim(text, ' ') <> '' WINDOW o AS (PARTITION BY artifact_id ORDER BY ord, block_id)),
j AS (SELECT *, page = p_page + 1 AND bottom >= 0.84 AND y <= 0.16 AS over_page, page = p_page AND p_lane = 'LEFT' AND lane = 'RIGHT' AS over_lane FROM b WHERE p_role = role AND p_section = section),
k AS (SELECT artifact_id, p_id AS from_id, block_id AS to_id, CASE WHEN over_page THEN 'PAGE' ELSE 'COLUMN' END AS "over", CASE WHEN before = '' OR after = '' OR regexp_matches(before, '[.!?。！？]\\s*$') OR regexp_matches(after, '^(?:[-•*]|\\d{{1,3}}[.)]|\\[\\d)') THEN NULL
  WHEN regexp_matches(before, '[^-]-$') AND regexp_matches(after, '^\\p{{Ll}}') THEN 'HYPHEN' WHEN regexp_matches(after, '^\\p{{Ll}}') THEN 'LOWER' WHEN regexp_matches(after, '^[,;:)\\]}}]') THEN 'MARK' WHEN regexp_matches(before, '\\p{{Han}}$') AND regexp_matches(after, '^\\p{{Han}}') THEN 'HAN' END AS how FROM j WHERE over_page OR over_lane)
SELECT * FROM k WHERE how IS NOT NULL""",
        "lib_metadata": f"""WITH t AS (SELECT paper_id, doc_id, coalesce(text, '') AS t FROM documents WHERE paper_id IS NOT NULL AND doc_id IS NOT NULL),
d AS (SELECT paper_id, doc_id, trim(regexp_extract(t, '^\\s*([^\\n]{{8,200}})', 1), ' ') AS title, {doi} AS doi, regexp_extract(t, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1) AS year, trim(regexp_extract(t, '{VENUE}'), ' ') AS venue, substr(regexp_extract(t, '{ABSTRACT}', 1), 1, {ABSTRACT_LENGTH}) AS abstract FROM t),
f AS (SELECT paper_id, {', '.join(f"min_by({n}, doc_id) FILTER ({n} <> '') AS f_{n}" for n in (*names, 'abstract'))} FROM d GROUP BY paper_id),
p AS (SELECT id, {title.format('title')} AS title, nullif(lower(regexp_replace(trim(doi, ' '), '^(?i:https?://[^/]+/|doi:\\s*)', '')), '') AS doi, CASE WHEN year BETWEEN 1900 AND 2099 THEN CAST(year AS VARCHAR) END AS year, {title.format('source')} AS venue FROM paper)
SELECT id, {', '.join(f"coalesce({own(n)}, f_{n}) AS {n}" for n in names)}, {' || '.join(f"CASE WHEN {own(n)} IS NOT NULL THEN 'r' WHEN f_{n} IS NOT NULL THEN 't' ELSE '-' END" for n in names)} AS origin, coalesce(length(f_abstract), 0) AS abstract FROM p LEFT JOIN f ON f.paper_id = p.id""",
        "txt_dois": r"""SELECT id, nullif(d, '') AS doi, regexp_matches(d, '^10\.\d{4,9}/\S{3,}$') AS whole FROM (SELECT id, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(doi, ''), '\s+', '', 'g')), '^(?:https?://[^/]+/|doi:)+', ''), '[.,;:)\]}]+$', '') AS d FROM paper)""",
    }
