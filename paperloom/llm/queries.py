"""Queries of problems 2, 3, 5, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.conversations import conversations, dropped_conversations
from paperloom.llm.packing import pack_documents
from paperloom.llm.sentences import split_sentences
from paperloom.llm.spellings import spelling_pairs
from paperloom.llm.splitting import oversized_items, split_tables
from paperloom.llm.tokens import encode_texts
from paperloom.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations to drop, with the reason."""
    return dropped_conversations(table(spark, folder, "research_message"))


def p2_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The kept conversations, one row a message in order."""
    return conversations(table(spark, folder, "research_message"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings of one person or one venue."""
    return spelling_pairs(table(spark, folder, "paper"), table(spark, folder, "name_form"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items over the limit."""
    return oversized_items(split_tables(table(spark, folder, "paper_layout_artifact"), table(spark, folder, "paper_memory"), with_text=False))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All items in pieces within the limit."""
    return split_tables(table(spark, folder, "paper_layout_artifact"), table(spark, folder, "paper_memory"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """A container for every document with tokens."""
    return pack_documents(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document."""
    return split_sentences(table(spark, folder, "documents"))


def queries() -> dict:
    """The queries of this subpackage."""
    own = (p2_found, p2_conversations, p3_found, p5_found, p5_pieces, p6_ids, p7_containers, p8_found)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB texts for what SQL can express; the rest is tested by brute force, round trips or held-out cases."""
    seen = r"[^\s\p{Z}\p{C}\x{2800}\x{3164}\x{FFA0}\x{115F}\x{1160}\x{034F}\x{FE00}-\x{FE0F}]"
    return {
        "p2_found": f"""WITH first AS (SELECT *, row_number() OVER (PARTITION BY session_id, message_key ORDER BY id) AS rn FROM research_message WHERE session_id IS NOT NULL),
told AS (SELECT session_id, id, created_at, CASE
    WHEN lower(trim(role)) IN ('user', 'human', '用户') THEN 'U'
    WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', '助手') THEN 'A'
    WHEN lower(trim(role)) IN ('system', '系统') THEN 'S' END AS who
  FROM first WHERE rn = 1 AND upper(message_type) = 'CHAT' AND regexp_matches(content, '{seen}')),
two AS (SELECT *, lag(who) OVER w AS before, lead(who) OVER w AS after FROM told WHERE who IN ('U', 'A')
  WINDOW w AS (PARTITION BY session_id ORDER BY created_at NULLS LAST, id)),
judged AS (SELECT s.session_id, CASE
    WHEN NOT EXISTS (SELECT 1 FROM two t WHERE t.session_id = s.session_id) THEN 'empty'
    WHEN EXISTS (SELECT 1 FROM told t WHERE t.session_id = s.session_id AND t.who IS NULL) THEN 'broken'
    WHEN EXISTS (SELECT 1 FROM two t WHERE t.session_id = s.session_id AND (t.created_at IS NULL OR t.who = 'A' AND t.before IS NULL)) THEN 'broken'
    WHEN EXISTS (SELECT 1 FROM two t WHERE t.session_id = s.session_id AND t.who = 'U' AND t.after IS DISTINCT FROM 'A') THEN 'missing_reply' END AS reason
  FROM (SELECT DISTINCT session_id FROM research_message WHERE session_id IS NOT NULL) s)
SELECT session_id, reason FROM judged WHERE reason IS NOT NULL""",
        "p5_found": """WITH b AS (SELECT id, CASE WHEN json_valid(blocks_json) THEN blocks_json END AS j FROM paper_layout_artifact),
e AS (SELECT id, CASE WHEN json_valid(structure_json) THEN structure_json END AS j FROM paper_memory),
items AS (
  SELECT 'paper_layout_artifact' AS record_table, id AS record_id, unnest(CAST(j AS JSON[])) AS item, 'text' AS k FROM b WHERE json_type(j) = 'ARRAY'
  UNION ALL
  SELECT 'paper_memory', id, unnest(CAST(json_extract(j, '$.elements') AS JSON[])), 'content' FROM e WHERE json_type(j, '$.elements') = 'ARRAY')
SELECT DISTINCT record_table, record_id, item ->> 'id' AS item_id FROM items WHERE length(item ->> k) > 1200""",
    }
