"""Queries that give tables as they are after a write: inserts, conditional updates, links, backfills, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import metadata as M
from paperloom.operators import rows as R
from paperloom.session import table


def row_inserted(spark: SparkSession, folder: str) -> DataFrame:
    """Finished calls with those others inserted whose tool call isn't there yet."""
    c = table(spark, folder, "agent_tool_call").filter("tool_call_id is not null").select("tool_call_id", "id", "status")
    return R.insert_ignore(c.filter("status = 'SUCCEEDED'"), c.filter("status != 'SUCCEEDED'"), ["tool_call_id"])


def row_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Calls after closing all that have an error, as of version 2: only rows that still have that version change."""
    c = table(spark, folder, "agent_tool_call").select("id", "version", "status")
    changes = table(spark, folder, "agent_tool_call").filter("error_code is not null").select("id", F.lit(2).alias("version"), F.lit("CLOSED").alias("status"))
    return R.compare_and_set(c, changes, "id", "version", ["status"])


def row_linked(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of all papers after those of read papers are replaced by their first two, the second first."""
    p = table(spark, folder, "paper").select("id", "keywords", "reading_status")
    wanted = p.filter("reading_status = 'READ'").select("id", F.reverse(F.slice(M.tag_list("keywords"), 1, 2)).alias("tags"))
    return R.replace_links(M.tags(p, "id", "keywords"), wanted, "id", "tags", "tag")


def row_backfilled(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with a missing DOI or source filled from the least of their documents' values."""
    said = table(spark, folder, "documents").filter("paper_id is not null").groupBy("paper_id").agg(F.min(F.nullif(M.find_doi(F.coalesce("text", F.lit(""))), F.lit(""))).alias("doi"), F.min("source").alias("source"))
    return R.backfill(table(spark, folder, "paper").select("id", "doi", "source"), said.withColumnRenamed("paper_id", "id"), "id", ["doi", "source"])


def row_managed(spark: SparkSession, folder: str) -> DataFrame:
    """Papers as a client sends them, with what the server manages (pages, seconds) as it was."""
    p = table(spark, folder, "paper")
    sent = p.select("id", F.upper("title").alias("title"), F.lit(0).alias("read_seconds"), F.lit(0).alias("current_page"))
    return R.keep_managed(p.select("id", "read_seconds", "current_page"), sent, "id", ["read_seconds", "current_page"])


def row_compared(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with a memory against papers with a layout: missing, extra, both."""
    return R.full_comparison(table(spark, folder, "paper_memory").filter("paper_id is not null"), table(spark, folder, "paper_layout_artifact").filter("paper_id is not null"), "paper_id")


def row_named(spark: SparkSession, folder: str) -> DataFrame:
    """The first of source, title and DOI that says something, for every paper."""
    return table(spark, folder, "paper").select("id", R.first_text("source", "title", "doi").alias("name"))


def queries() -> dict:
    """The queries of this module."""
    return {n: f for n, f in globals().items() if n.startswith("row_")}


def oracle_sql() -> dict[str, str]:
    """DuckDB texts with the same results."""
    doi = r"nullif(regexp_replace(lower(regexp_extract(coalesce(text, ''), '(10\.\d{4,9}/[^\s\"<>]+)', 1)), '[.,;:)\]}]+$', ''), '')"
    parts = "list_filter(list_transform(regexp_split_to_array(keywords, '[,;，；]'), lambda x: trim(x, ' ')), lambda x: x <> '')"
    once = f"list_filter({parts}, lambda x, i: list_position({parts}, x) = i)"
    return {
        "row_inserted": """WITH c AS (SELECT tool_call_id, id, status FROM agent_tool_call WHERE tool_call_id IS NOT NULL), b AS (SELECT * FROM c WHERE status = 'SUCCEEDED')
SELECT * FROM b UNION ALL SELECT * FROM c WHERE status <> 'SUCCEEDED' AND tool_call_id NOT IN (SELECT tool_call_id FROM b) QUALIFY row_number() OVER (PARTITION BY tool_call_id ORDER BY id) = 1""",
        "row_changed": "SELECT id, CASE WHEN error_code IS NOT NULL AND version = 2 THEN 3 ELSE version END AS version, CASE WHEN error_code IS NOT NULL AND version = 2 THEN 'CLOSED' ELSE status END AS status FROM agent_tool_call",
        "row_linked": f"""WITH p AS (SELECT id, reading_status, {once} AS ts FROM paper), q AS (SELECT id, CASE WHEN reading_status = 'READ' THEN list_reverse(list_slice(ts, 1, 2)) ELSE ts END AS ts FROM p)
SELECT id, CAST(i - 1 AS INTEGER) AS position, t AS tag FROM (SELECT id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM q)""",
        "row_backfilled": f"""WITH s AS (SELECT paper_id, min({doi}) AS doi, min(source) AS source FROM documents WHERE paper_id IS NOT NULL GROUP BY paper_id)
SELECT p.id, coalesce(p.doi, s.doi) AS doi, coalesce(p.source, s.source) AS source FROM paper p LEFT JOIN s ON s.paper_id = p.id""",
        "row_managed": "SELECT id, upper(title) AS title, read_seconds, current_page FROM paper",
        "row_compared": """SELECT count(*) FILTER (a.paper_id IS NULL) AS missing, count(*) FILTER (m.paper_id IS NULL) AS extra, count(*) FILTER (a.paper_id IS NOT NULL AND m.paper_id IS NOT NULL) AS both
FROM (SELECT DISTINCT paper_id FROM paper_memory WHERE paper_id IS NOT NULL) m FULL JOIN (SELECT DISTINCT paper_id FROM paper_layout_artifact WHERE paper_id IS NOT NULL) a ON a.paper_id = m.paper_id""",
        "row_named": "SELECT id, coalesce(nullif(trim(source, ' '), ''), nullif(trim(title, ' '), ''), nullif(trim(doi, ' '), '')) AS name FROM paper",
    }
