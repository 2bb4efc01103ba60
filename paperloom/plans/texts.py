"""Queries that apply the text functions to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import chunks as C
from paperloom.functions import metadata as M
from paperloom.functions import text as T
from paperloom.session import table

#: Classes of errors by words, the first that fits, and those that may be tried again.
FAILURES = [
    ("MODEL_TIMEOUT", ["timeout", "timed out"]),
    ("MODEL_OVERLOADED", ["overloaded", "rate limit", "rate_limit", "429"]),
    ("CONTEXT_BUDGET_EXCEEDED", ["context_budget_exceeded"]),
    ("AGENT_CALL_LIMIT", ["model_call_limit_exceeded", "tool_call_limit_exceeded"]),
    ("TOOL_ROUND_LIMIT", ["max tool", "tool calling round"]),
    ("TOOL_OUTPUT_OVERSIZE", ["payload limit", "result exceeded"]),
    ("ANSWER_SUBMISSION_REQUIRED", ["answer_submission_required"]),
    ("EVIDENCE_SUBMISSION_REQUIRED", ["grounding_submission_required"]),
    ("EVIDENCE_VALIDATION_FAILED", ["citation", "grounded source", "source was not read"]),
    ("MODEL_TOOL_CALLING_UNAVAILABLE", ["capability_not_verified", "did_not_call_tool"]),
    ("MODEL_EMPTY_RESPONSE", ["empty response", "empty direct answer", "空响应"]),
    ("MODEL_CONNECTION_FAILED", ["connect", "network", "socket"]),
]
RETRY = ["MODEL_TIMEOUT", "MODEL_OVERLOADED", "MODEL_EMPTY_RESPONSE", "MODEL_CONNECTION_FAILED"]
#: Topics by expressions, the first that is found.
TOPICS = [
    ("AAoI", r"(?i)\b(?:AAoI|AoI|age of information)\b"),
    ("Ergodic Rate", r"(?i)\b(?:ergodic[- ]?(?:sum[- ]?)?rate|ergodic performance)\b|遍历(?:和)?速率"),
    ("Sum Rate", r"(?i)\b(?:sum[- ]?rate|achievable rate|average rate)\b|(?:和|总|可达)速率"),
    ("Rate Region", r"(?i)\b(?:rate region|rate[- ]?region)\b"),
    ("Throughput", r"(?i)\b(?:throughput|goodput|effective throughput)\b"),
    ("Fairness", r"(?i)\b(?:fairness|max[- ]?min|minimum rate)\b"),
    ("Energy Efficiency", r"(?i)\b(?:energy efficiency|energy[- ]?efficient)\b"),
    ("Error Probability", r"(?i)\b(?:error probability|block error rate|BLER)\b"),
    ("Latency", r"(?i)\b(?:latency|delay)\b"),
    ("Autonomous Driving", r"(?i)\b(?:autonomous driving|autonomous vehicles?)\b"),
    ("URLLC", r"(?i)\bURLLC\b"),
    ("Vehicular", r"(?i)\b(?:vehicular|vehicle|V2X)\b"),
    ("Satellite IoT", r"(?i)\b(?:satellite(?:[- ]based)? IoT|satellite)\b"),
    ("IoT", r"(?i)\bIoT\b"),
    ("UAV", r"(?i)\b(?:UAV|drone)\b"),
    ("RSMA", r"(?i)\bRSMA\b"),
    ("NOMA", r"(?i)\bNOMA\b"),
    ("Beamforming", r"(?i)\bbeamforming\b"),
    ("Power Allocation", r"(?i)\bpower allocation\b"),
    ("Reinforcement Learning", r"(?i)\breinforcement learning\b"),
]
#: What a paper has, and how much prose.
IDENTIFIER = r"(?i)(?:10\.\d{4,9}/[-._;()/:a-z0-9]+|arxiv\s*:?\s*\d{4}\.\d{4,5}(?:v\d+)?)"
ABSTRACT = r"(?i)(?:^|\n)\s*(?:abstract|摘要)(?:[^A-Za-z0-9_]|$)"
SECTIONS = (
    r"(?im)^[ \t]*(?:\d+(?:\.\d+)*\s+)?(?:introduction|background|preliminaries|method(?:ology)?|approach|system model|proposed method|experiments?|results?|discussion|"
    r"conclusion|references|引言|背景|预备知识|方法|实验|结果|讨论|结论|参考文献)[ \t]*[:：.]?[ \t]*$"
)
PROSE, SHORT_PROSE = 600, 280


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents."""
    return table(spark, folder, "documents")


def txt_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and venues without markup and spare spaces, with the year if it is one."""
    year = F.when(F.col("year").between(1900, 2099), F.col("year"))
    return table(spark, folder, "paper").select("id", M.clean_title(F.col("title")).alias("title"), F.regexp_replace(M.clean_title(F.col("source")), r"\.$", "").alias("source"), year.alias("year"))


def txt_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language hints against the given language, in one spelling."""
    given = F.lower(F.split("lang", "-")[0])
    return docs(spark, folder).groupBy(given.alias("given"), T.language(F.col("text")).alias("hint")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))


def txt_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct tokens of the corpus with the documents and mentions they have."""
    return docs(spark, folder).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def txt_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of documents of the same letters and digits: least id and size."""
    d = docs(spark, folder).select("doc_id", F.sha2(T.compact(F.coalesce("text", F.lit(""))), 256).alias("key"))
    c = d.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return d.join(c, "key").select("doc_id", "class_id", "copies")


def txt_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers and years that the documents mention, per kind of document."""
    t = F.coalesce("text", F.lit(""))
    return docs(spark, folder).groupBy("doc_kind").agg(
        F.count_if(M.find_doi(t) != "").alias("doi"), F.count_if(M.find_arxiv(t) != "").alias("arxiv"), F.count_if(M.find_year(t).isNotNull()).alias("year"), F.min(M.find_year(t)).alias("first_year"), F.max(M.find_year(t)).alias("last_year")
    )


def txt_review(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a document looks like a paper: an identifier; an abstract with a section and some prose; or two sections
    with more. Short texts without any are none; of the others nothing is sure. Prose is the letters of lines of 40
    characters and more."""
    t = F.coalesce("text", F.lit(""))
    prose = F.aggregate(F.filter(F.split(t, "\n"), lambda line: F.length(line) >= 40), F.lit(0), lambda n, line: n + F.length(F.regexp_replace(line, r"[^\p{L}]", "")))
    d = docs(spark, folder).select("doc_kind", t.rlike(IDENTIFIER).alias("named"), t.rlike(ABSTRACT).alias("abstract"), F.regexp_count(t, F.lit(SECTIONS.replace("(?im)", "(?imd)"))).alias("sections"), prose.alias("prose"))
    paper = F.col("named") | (F.col("abstract") & (F.col("sections") >= 1) & (F.col("prose") >= SHORT_PROSE)) | ((F.col("sections") >= 2) & (F.col("prose") >= PROSE))
    none = ~F.col("abstract") & (F.col("sections") == 0) & (F.col("prose") < SHORT_PROSE)
    return d.groupBy("doc_kind", F.when(paper, "PAPER").when(none, "NOT_PAPER").otherwise("UNCERTAIN").alias("review")).agg(F.count("*").alias("documents"))


def txt_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by the class of their error, and whether that may be tried again; NONE without an error."""
    c = F.when(F.col("error_code").isNull(), "NONE").otherwise(T.classified(F.col("error_code"), FAILURES, "AGENT_INTERNAL_ERROR"))
    return table(spark, folder, "agent_tool_call").groupBy(c.alias("failure")).agg(F.count("*").alias("calls"), F.max(c.isin(RETRY)).alias("retry"))


def topic_of(text: Column) -> Column:
    """The first topic whose expression a text has; OTHER if none."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.when(text.rlike(p), name) for name, p in TOPICS], F.lit("OTHER"))


def txt_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Papers by the first topic that their title and keywords name."""
    return table(spark, folder, "paper").groupBy(topic_of(F.concat_ws(" ", "title", "keywords")).alias("topic")).agg(F.count("*").alias("papers"))


def txt_names(spark: SparkSession, folder: str) -> DataFrame:
    """Tools and parser names as words."""
    return table(spark, folder, "agent_tool_call").groupBy(T.words_of_name("tool_name").alias("words")).agg(F.count("*").alias("calls"))


def txt_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Reading time of every paper in hours and minutes."""
    return table(spark, folder, "paper").select("id", T.duration(F.col("read_seconds")).alias("reading"))


def txt_previews(spark: SparkSession, folder: str) -> DataFrame:
    """Every message's preview of at most 40 characters."""
    return table(spark, folder, "research_message").select("id", T.shortened(T.collapsed(F.coalesce("content", F.lit(""))), 40).alias("preview"))


def txt_protected(spark: SparkSession, folder: str) -> DataFrame:
    """Protected spans per kind of document, and documents that come back as they were."""
    t = F.coalesce("text", F.lit(""))
    return docs(spark, folder).groupBy("doc_kind").agg(F.sum(F.regexp_count(C.protect(t), F.lit("<keep>"))).cast("bigint").alias("spans"), F.count_if(C.restore(C.protect(t)) == t).alias("same"))


def txt_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most 2 000 characters of every document."""
    return C.chunk_texts(docs(spark, folder), "doc_id", "text", 2000)


def txt_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of every artifact in batches of at most 8 and 4 KiB."""
    from paperloom.operators.layout import layout_blocks

    b = layout_blocks(table(spark, folder, "paper_layout_artifact")).select("artifact_id", "ord", "block_id", F.octet_length("text").alias("bytes"))
    return C.batches(b, "artifact_id", ["ord", "block_id"], "bytes", 8, 4096)


def txt_math(spark: SparkSession, folder: str) -> DataFrame:
    """Formula blocks in LaTeX, with the state of each."""
    from paperloom.operators.layout import layout_blocks

    b = layout_blocks(table(spark, folder, "paper_layout_artifact")).filter("role = 'FORMULA'").select(F.concat_ws("-", "artifact_id", "block_id").alias("block"), "text")
    return C.transcribe(b, "block", "text")


def txt_compact(spark: SparkSession, folder: str) -> DataFrame:
    """Results of calls as bounded JSON: how many bytes are left."""
    shrink = F.pandas_udf(lambda s: s.map(lambda x: C.compacted(x, 3, 2, 20)), "string")
    return table(spark, folder, "agent_tool_call").select("id", F.octet_length(shrink("result_json")).alias("bytes"))


def txt_normal(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text changes under compatibility composition, per kind."""
    d = docs(spark, folder).select("doc_kind", "text", T.nfkc("text").alias("n"))
    return d.groupBy("doc_kind").agg(F.count("*").alias("documents"), F.count_if(F.col("n") != F.col("text")).alias("changed"))


def txt_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Content hashes of all messages, nulls as empty."""
    return table(spark, folder, "research_message").select("id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))


def queries() -> dict:
    """The queries of this module."""
    return {n: f for n, f in globals().items() if n.startswith("txt_")}


def oracle_sql() -> dict[str, str]:
    """DuckDB texts with the same results; chunks, batches, mathematics and normal forms are tested by brute force."""
    title = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
    lang = "CASE WHEN text IS NULL THEN NULL WHEN han >= 2 AND han >= latin * 0.12 THEN 'ZH' ELSE 'EN' END"
    year = "CAST(nullif(regexp_extract(t, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS INTEGER)"
    t = "(SELECT *, coalesce(text, '') AS t FROM documents)"

    def cases(column: str, rules: list, other: str) -> str:
        low = f"lower(coalesce({column}, ''))"
        return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({low}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules) + f" ELSE '{other}' END"

    keep = C.PROTECTED.replace("'", "''")
    return {
        "txt_titles": f"SELECT id, {title.format('title')} AS title, regexp_replace({title.format('source')}, '\\.$', '') AS source, CASE WHEN year BETWEEN 1900 AND 2099 THEN year END AS year FROM paper",
        "txt_languages": f"""SELECT lower(split_part(lang, '-', 1)) AS given, {lang} AS hint, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters
FROM (SELECT *, length(regexp_replace(text, '[^\\p{{Han}}]', '', 'g')) AS han, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM documents) GROUP BY ALL""",
        "txt_tokens": f"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower({T.sql_unified('text')}), '[\\p{{Han}}]+|[\\p{{Latin}}\\p{{N}}_-]+|[\\p{{Greek}}\\p{{N}}]+'), lambda x: length(x) > 1))) AS token FROM documents)
SELECT token, count(*) AS documents, min(doc_id) AS first_doc FROM t GROUP BY token""",
        "txt_copies": f"WITH k AS (SELECT doc_id, regexp_replace(lower({T.sql_unified("coalesce(text, '')")}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS key FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS copies FROM k",
        "txt_identifiers": f"""SELECT doc_kind, count(*) FILTER (regexp_matches(t, '10\\.\\d{{4,9}}/[^\\s"<>]+')) AS doi, count(*) FILTER (regexp_matches(t, '(?i)arxiv[:/\\s]*(?:abs/)?(\\d{{4}}\\.\\d{{4,5}}|[a-z-]+/\\d{{7}})')) AS arxiv,
count({year}) AS year, min({year}) AS first_year, max({year}) AS last_year FROM {t} GROUP BY doc_kind""",
        "txt_review": f"""WITH s AS (SELECT doc_kind, regexp_matches(t, '{IDENTIFIER}') AS named, regexp_matches(t, '{ABSTRACT}') AS abstract, len(regexp_extract_all(t, '{SECTIONS}')) AS sections,
  length(regexp_replace(array_to_string(list_filter(str_split(t, chr(10)), lambda x: length(x) >= 40), ''), '[^\\p{{L}}]', '', 'g')) AS prose FROM {t})
SELECT doc_kind, CASE WHEN named OR abstract AND sections >= 1 AND prose >= {SHORT_PROSE} OR sections >= 2 AND prose >= {PROSE} THEN 'PAPER' WHEN NOT abstract AND sections = 0 AND prose < {SHORT_PROSE} THEN 'NOT_PAPER' ELSE 'UNCERTAIN' END AS review, count(*) AS documents FROM s GROUP BY ALL""",
        "txt_failures": f"SELECT failure, count(*) AS calls, max(failure IN ({', '.join(repr(x) for x in RETRY)})) AS retry FROM (SELECT CASE WHEN error_code IS NULL THEN 'NONE' ELSE {cases('error_code', FAILURES, 'AGENT_INTERNAL_ERROR')} END AS failure FROM agent_tool_call) GROUP BY 1",
        "txt_topics": "SELECT CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in TOPICS) + " ELSE 'OTHER' END AS topic, count(*) AS papers FROM (SELECT concat_ws(' ', title, keywords) AS t FROM paper) GROUP BY 1",
        "txt_names": "SELECT trim(lower(regexp_replace(regexp_replace(tool_name, '(\\p{Ll}|\\d)(\\p{Lu})', '\\1 \\2', 'g'), '[^\\p{L}\\p{Nd}]+', ' ', 'g')), ' ') AS words, count(*) AS calls FROM agent_tool_call GROUP BY 1",
        "txt_durations": "SELECT id, CASE WHEN read_seconds >= 3600 THEN format('{}h {:02d}m', read_seconds // 3600, read_seconds % 3600 // 60) ELSE format('{}m', read_seconds % 3600 // 60) END AS reading FROM paper",
        "txt_previews": """SELECT id, CASE WHEN length(c) > 40 THEN substr(c, 1, 39) || '…' ELSE c END AS preview FROM (SELECT id, trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g'), ' ') AS c FROM research_message)""",
        "txt_protected": f"SELECT doc_kind, CAST(sum(len(regexp_extract_all(t, '{keep}'))) AS BIGINT) AS spans, count(*) AS same FROM {t} GROUP BY doc_kind",
        "txt_hashes": "SELECT id, sha256(coalesce(content, '')) AS hash FROM research_message",
    }
