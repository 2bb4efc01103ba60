"""Queries over messages and tool calls: per-session state, turns, budgets, feeds, idempotency.

One session may hold a large part of all rows, so running values come from ``scan_groups`` and latest rows from
aggregates with map-side combine, never from a window over a whole session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import rows as R
from paperloom.operators.grounding import context_levels
from paperloom.operators.sequences import islands, lag_values, number_rows, scan_groups
from paperloom.session import table


def in_time() -> list[Column]:
    """Order of messages: by time, rows without one last, then id."""
    return [F.col("created_at").asc_nulls_last(), F.col("id").asc()]


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of sessions."""
    return table(spark, folder, "research_message").filter("session_id is not null")


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """Final chat messages of users and assistants by plain role, one row a (session, key)."""
    m = messages(spark, folder).filter("upper(message_type) = 'CHAT' and message_status = 'FINAL'").select("session_id", "message_key", "id", "created_at", "content", F.upper(F.trim("role")).alias("role"))
    first = m.groupBy("session_id", "message_key").agg(F.min_by(F.struct("id", "created_at", "content", "role"), "id").alias("r"))
    return first.select("session_id", "r.*").filter("role in ('USER', 'ASSISTANT')")


def estimated_tokens(text: Column) -> Column:
    """Tokens by a rule: one for 3.5 ASCII characters and one for each other, rounded up."""
    ascii_ = F.length(F.regexp_replace(text, r"[^\x{00}-\x{7F}]", ""))
    return F.ceil(ascii_ / 3.5 + (F.length(text) - ascii_)).cast("bigint")


def ses_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Messages, distinct runs, roles and last activity per session."""
    role = F.upper(F.trim("role"))
    return messages(spark, folder).groupBy("session_id").agg(
        F.count("*").alias("messages"), F.countDistinct("run_id").alias("runs"), F.count_if(role == "USER").alias("users"), F.count_if(role == "ASSISTANT").alias("assistants"), F.max("created_at").alias("last_at")
    )


def ses_page(spark: SparkSession, folder: str) -> DataFrame:
    """First page of 30 of the sessions, latest activity first."""
    return R.page(ses_counts(spark, folder), [F.col("last_at").desc_nulls_last(), F.col("session_id").asc()], 1, 30).select("session_id", "messages", "last_at")


def ses_last_assistant(spark: SparkSession, folder: str) -> DataFrame:
    """The newest final assistant message of every session."""
    m = chat(spark, folder).filter("role = 'ASSISTANT' and created_at is not null")
    return R.latest_per_key(m.select("session_id", "created_at", "id", "content"), ["session_id"], ["created_at", "id"])


def ses_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """Per type and status: messages with text worth reading."""
    worth = F.col("content").rlike(r"[^\s\p{Z}]")
    return table(spark, folder, "research_message").groupBy(F.upper("message_type").alias("type"), F.col("message_status").alias("status")).agg(
        F.count("*").alias("messages"), F.count_if(worth).alias("worth"), F.sum(F.length("content")).alias("characters")
    )


def ses_turns(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, turn, user_rows, assistant_rows, characters): a user row opens a turn and assistant rows join it;
    turns that no assistant answered, and rows before the first turn, are left out."""
    m = islands(chat(spark, folder), ["session_id"], in_time(), F.col("role") == "USER", "turn")
    turns = m.filter("turn > 0").groupBy("session_id", "turn").agg(
        F.count_if(F.col("role") == "USER").alias("user_rows"), F.count_if(F.col("role") == "ASSISTANT").alias("assistant_rows"), F.sum(F.length("content")).cast("bigint").alias("characters")
    )
    return turns.filter("assistant_rows > 0")


def ses_recent_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The last four answered turns of every session, the newest ranked 1."""
    return R.top_k(ses_turns(spark, folder).select("session_id", "turn", "characters"), ["session_id"], [F.col("turn").desc()], 4)


def ses_running(spark: SparkSession, folder: str) -> DataFrame:
    """Characters up to and with each message of its session, and the longest message so far."""
    m = messages(spark, folder).select("session_id", "id", "created_at", F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("characters"))
    out = scan_groups(m, ["session_id"], in_time(), {"before": ("sum", F.col("characters")), "most": ("max", F.col("characters"))})
    return out.select("session_id", "id", (F.coalesce("before", F.lit(0)) + F.col("characters")).alias("running"), F.greatest("most", "characters").alias("longest"))


def ses_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The newest messages of every session that fit into 2 000 characters together; at least the newest one."""
    m = chat(spark, folder).select("session_id", "id", "created_at", F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("characters"))
    out = scan_groups(m, ["session_id"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()], {"newer": ("sum", F.col("characters"))})
    kept = out.filter("newer is null or newer + characters <= 2000")
    return kept.groupBy("session_id").agg(F.count("*").alias("kept"), F.sum("characters").alias("characters"), F.min("id").alias("least_id"))


def ses_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Per session: sittings (a gap over 30 minutes starts one) and the longest pause in whole seconds."""
    m = messages(spark, folder).filter("created_at is not null").select("session_id", "id", "created_at")
    out = lag_values(m, ["session_id"], in_time(), {"previous": "created_at"})
    pause = F.timestamp_diff("SECOND", F.col("previous"), F.col("created_at"))
    return out.groupBy("session_id").agg((1 + F.count_if(pause > 1800)).alias("sittings"), F.max(pause).alias("longest_pause"))


def ses_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions to compact (over 8 messages or 6 000 characters) with the number to fold away (all but the last 6)."""
    s = chat(spark, folder).groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.coalesce(F.length("content"), F.lit(0))).cast("bigint").alias("characters"))
    return s.filter("messages > 8 or characters > 6000").select("session_id", "messages", "characters", F.greatest(F.lit(0).cast("bigint"), F.col("messages") - 6).alias("folded"))


def ses_context(spark: SparkSession, folder: str) -> DataFrame:
    """The first level of the context ladder that fits 150 tokens, per session."""
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    return context_levels(chat(spark, folder), "session_id", order, F.col("content"), 150)


def ses_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated tokens by role."""
    role = F.upper(F.trim("role"))
    return table(spark, folder, "research_message").groupBy(role.alias("role")).agg(F.count("*").alias("messages"), F.sum(estimated_tokens(F.col("content"))).alias("tokens"))


def ses_finished(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that count for a reader: not a user's, or without a run, or of a run with a call that succeeded."""
    runs = table(spark, folder, "agent_tool_call").filter("status = 'SUCCEEDED' and run_id is not null").select(F.col("run_id").alias("good_run")).distinct()
    m = messages(spark, folder).select("id", "session_id", "run_id", F.upper(F.trim("role")).alias("role"))
    joined = m.join(runs, F.col("run_id") == F.col("good_run"), "left")
    keep = F.coalesce(F.col("role") != "USER", F.lit(True)) | F.col("run_id").isNull() | F.col("good_run").isNotNull()
    return joined.filter(keep).groupBy("session_id").agg(F.count("*").alias("messages"))


def run_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls per run, with the sessions and messages of the run."""
    calls = table(spark, folder, "agent_tool_call").filter("run_id is not null").groupBy("run_id").agg(F.count("*").alias("calls"), F.max("ordinal_no").cast("bigint").alias("last_ordinal"), F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"))
    m = messages(spark, folder).filter("run_id is not null").groupBy("run_id").agg(F.min("session_id").alias("session_id"), F.count("*").alias("messages"))
    return calls.join(m, "run_id")


def run_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of calls that no message names."""
    known = table(spark, folder, "research_message").select("run_id")
    return table(spark, folder, "agent_tool_call").filter("run_id is not null").select("run_id").distinct().join(known, "run_id", "left_anti")


def run_feed(spark: SparkSession, folder: str) -> DataFrame:
    """All events of every run (messages, calls requested, calls ended), numbered in order of time, kind and id."""
    m = table(spark, folder, "research_message").filter("run_id is not null and created_at is not null").select("run_id", F.lit("message").alias("kind"), F.col("id").alias("ref"), F.col("created_at").alias("at"))
    c = table(spark, folder, "agent_tool_call").filter("run_id is not null")
    asked = c.filter("started_at is not null").select("run_id", F.lit("call").alias("kind"), F.col("id").alias("ref"), F.col("started_at").alias("at"))
    ended = c.filter("completed_at is not null").select("run_id", F.lit("result").alias("kind"), F.col("id").alias("ref"), F.col("completed_at").alias("at"))
    return number_rows(m.unionByName(asked).unionByName(ended), ["run_id"], [F.col("at").asc(), F.col("kind").asc(), F.col("ref").asc()], "event_no").select("run_id", "event_no", "kind", "ref")


def run_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Per tool: calls, mean and longest milliseconds, and how many ran over 5 s."""
    ms = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("completed_at"))
    return table(spark, folder, "agent_tool_call").groupBy("tool_name").agg(
        F.count("*").alias("calls"), F.count_if(ms > 5000).alias("slow"), F.round(F.avg(ms), 3).alias("mean_ms"), F.max(ms).alias("longest_ms"), F.sum("attempt_count").alias("attempts")
    )


def run_status(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by tool, status and error."""
    return table(spark, folder, "agent_tool_call").groupBy("tool_name", "status", "error_code").agg(F.count("*").alias("calls"), F.countDistinct("run_id").alias("runs"))


def run_idempotency(spark: SparkSession, folder: str) -> DataFrame:
    """Idempotency keys used more than once: a conflict if the arguments differ."""
    c = table(spark, folder, "agent_tool_call").filter("idempotency_key is not null")
    return c.groupBy("idempotency_key").agg(F.count("*").alias("calls"), F.countDistinct(F.sha2(F.concat_ws("|", "tool_name", F.coalesce("arguments_json", F.lit(""))), 256)).alias("requests")).filter("calls > 1").withColumn("conflict", F.col("requests") > 1)


def run_redelivered(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of every tool call, with how often it was delivered."""
    c = table(spark, folder, "agent_tool_call").filter("tool_call_id is not null")
    return c.groupBy("tool_call_id").agg(F.min("id").alias("id"), F.count("*").alias("deliveries"), F.max_by("status", F.struct("version", "id")).alias("last_status"))


def queries() -> dict:
    """The queries of this module."""
    return {n: f for n, f in globals().items() if n.startswith(("ses_", "run_"))}


_CHAT = """chat AS (SELECT session_id, id, created_at, content, role FROM (
  SELECT session_id, id, created_at, content, upper(trim(role)) AS role, row_number() OVER (PARTITION BY session_id, message_key ORDER BY id) AS rn
  FROM research_message WHERE session_id IS NOT NULL AND upper(message_type) = 'CHAT' AND message_status = 'FINAL') WHERE rn = 1 AND role IN ('USER', 'ASSISTANT'))"""
_TURNS = f"""{_CHAT}, numbered AS (SELECT *, count(*) FILTER (role = 'USER') OVER (PARTITION BY session_id ORDER BY created_at NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS turn FROM chat),
turns AS (SELECT session_id, turn, count(*) FILTER (role = 'USER') AS user_rows, count(*) FILTER (role = 'ASSISTANT') AS assistant_rows, CAST(sum(length(content)) AS BIGINT) AS characters
  FROM numbered WHERE turn > 0 GROUP BY ALL HAVING count(*) FILTER (role = 'ASSISTANT') > 0)"""
_M = "m AS (SELECT session_id, id, created_at, CAST(coalesce(length(content), 0) AS BIGINT) AS characters FROM research_message WHERE session_id IS NOT NULL)"


def oracle_sql() -> dict[str, str]:
    """DuckDB texts with the same results."""
    counts = """SELECT session_id, count(*) AS messages, count(DISTINCT run_id) AS runs, count(*) FILTER (upper(trim(role)) = 'USER') AS users,
count(*) FILTER (upper(trim(role)) = 'ASSISTANT') AS assistants, max(created_at) AS last_at FROM research_message WHERE session_id IS NOT NULL GROUP BY session_id"""
    tokens = "CAST(ceil(length(regexp_replace(content, '[^\\x{00}-\\x{7F}]', '', 'g')) / CAST(3.5 AS DOUBLE) + (length(content) - length(regexp_replace(content, '[^\\x{00}-\\x{7F}]', '', 'g')))) AS BIGINT)"
    def cut_tokens(n: int) -> str:
        cut = f"(CASE WHEN length(coalesce(content, '')) > {n} THEN substr(content, 1, {n - 1}) || '…' ELSE coalesce(content, '') END)"
        return tokens.replace("content", cut)

    ladder = [(8, 900), (6, 600), (4, 360), (2, 220)]
    sums = ", ".join(f"CAST(sum({cut_tokens(c)}) FILTER (n <= {k}) AS BIGINT) AS t{i}, count(*) FILTER (n <= {k}) AS m{i}" for i, (k, c) in enumerate(ladder))
    return {
        "ses_context": f"""WITH {_CHAT}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, id DESC) AS n FROM chat),
s AS (SELECT session_id, {sums} FROM n GROUP BY session_id), l AS (SELECT *, CASE WHEN t0 <= 150 THEN 0 WHEN t1 <= 150 THEN 1 WHEN t2 <= 150 THEN 2 ELSE 3 END AS level FROM s)
SELECT session_id, level, [m0, m1, m2, m3][level + 1] AS messages, [t0, t1, t2, t3][level + 1] AS tokens FROM l""",
        "ses_counts": counts,
        "ses_page": f"SELECT session_id, messages, last_at FROM ({counts}) ORDER BY last_at DESC NULLS LAST, session_id LIMIT 30",
        "ses_last_assistant": f"WITH {_CHAT} SELECT session_id, created_at, id, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS rn FROM chat WHERE role = 'ASSISTANT' AND created_at IS NOT NULL) WHERE rn = 1",
        "ses_semantic": r"SELECT upper(message_type) AS type, message_status AS status, count(*) AS messages, count(*) FILTER (regexp_matches(content, '[^\s\p{Z}]')) AS worth, CAST(sum(length(content)) AS BIGINT) AS characters FROM research_message GROUP BY ALL",
        "ses_turns": f"WITH {_TURNS} SELECT session_id, turn, user_rows, assistant_rows, characters FROM turns",
        "ses_recent_turns": f"WITH {_TURNS} SELECT session_id, turn, characters, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS INTEGER) AS rank FROM turns) WHERE rank <= 4",
        "ses_running": f"""WITH {_M} SELECT session_id, id, CAST(sum(characters) OVER w AS BIGINT) AS running, max(characters) OVER w AS longest FROM m
WINDOW w AS (PARTITION BY session_id ORDER BY created_at NULLS LAST, id ROWS UNBOUNDED PRECEDING)""",
        "ses_budget": f"""WITH {_CHAT}, c AS (SELECT session_id, id, CAST(coalesce(length(content), 0) AS BIGINT) AS characters, CAST(sum(coalesce(length(content), 0)) OVER w AS BIGINT) AS total,
  row_number() OVER w AS rn FROM chat WINDOW w AS (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, id DESC ROWS UNBOUNDED PRECEDING))
SELECT session_id, count(*) AS kept, CAST(sum(characters) AS BIGINT) AS characters, min(id) AS least_id FROM c WHERE rn = 1 OR total <= 2000 GROUP BY session_id""",
        "ses_gaps": """WITH p AS (SELECT session_id, (epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at, id))) // 1000000 AS pause
  FROM research_message WHERE session_id IS NOT NULL AND created_at IS NOT NULL)
SELECT session_id, 1 + count(*) FILTER (pause > 1800) AS sittings, max(pause) AS longest_pause FROM p GROUP BY session_id""",
        "ses_compaction": f"""WITH {_CHAT}, s AS (SELECT session_id, count(*) AS messages, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS characters FROM chat GROUP BY session_id)
SELECT session_id, messages, characters, greatest(0, messages - 6) AS folded FROM s WHERE messages > 8 OR characters > 6000""",
        "ses_tokens": f"SELECT upper(trim(role)) AS role, count(*) AS messages, CAST(sum({tokens}) AS BIGINT) AS tokens FROM research_message GROUP BY 1",
        "ses_finished": """SELECT session_id, count(*) AS messages FROM research_message m WHERE session_id IS NOT NULL AND (coalesce(upper(trim(role)) <> 'USER', true) OR run_id IS NULL
OR EXISTS (SELECT 1 FROM agent_tool_call c WHERE c.run_id = m.run_id AND c.status = 'SUCCEEDED')) GROUP BY session_id""",
        "run_calls": """SELECT c.run_id, c.calls, c.last_ordinal, c.succeeded, m.session_id, m.messages FROM
(SELECT run_id, count(*) AS calls, CAST(max(ordinal_no) AS BIGINT) AS last_ordinal, count(*) FILTER (status = 'SUCCEEDED') AS succeeded FROM agent_tool_call GROUP BY run_id) c
JOIN (SELECT run_id, min(session_id) AS session_id, count(*) AS messages FROM research_message WHERE session_id IS NOT NULL GROUP BY run_id) m ON c.run_id = m.run_id""",
        "run_orphans": "SELECT DISTINCT run_id FROM agent_tool_call c WHERE run_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM research_message m WHERE m.run_id = c.run_id)",
        "run_feed": """WITH f AS (SELECT run_id, 'message' AS kind, id AS ref, created_at AS ts FROM research_message WHERE run_id IS NOT NULL AND created_at IS NOT NULL
  UNION ALL SELECT run_id, 'call', id, started_at FROM agent_tool_call WHERE run_id IS NOT NULL AND started_at IS NOT NULL
  UNION ALL SELECT run_id, 'result', id, completed_at FROM agent_tool_call WHERE run_id IS NOT NULL AND completed_at IS NOT NULL)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, kind, ref) AS event_no, kind, ref FROM f""",
        "run_durations": """SELECT tool_name, count(*) AS calls, count(*) FILTER (ms > 5000) AS slow, round(avg(ms), 3) AS mean_ms, max(ms) AS longest_ms, CAST(sum(attempt_count) AS BIGINT) AS attempts
FROM (SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) // 1000 AS ms FROM agent_tool_call) GROUP BY tool_name""",
        "run_status": "SELECT tool_name, status, error_code, count(*) AS calls, count(DISTINCT run_id) AS runs FROM agent_tool_call GROUP BY ALL",
        "run_idempotency": """SELECT idempotency_key, count(*) AS calls, count(DISTINCT sha256(concat_ws('|', tool_name, coalesce(arguments_json, '')))) AS requests,
count(DISTINCT sha256(concat_ws('|', tool_name, coalesce(arguments_json, '')))) > 1 AS conflict FROM agent_tool_call WHERE idempotency_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
        "run_redelivered": """SELECT tool_call_id, min(id) AS id, count(*) AS deliveries, last(status ORDER BY version NULLS FIRST, id) AS last_status FROM agent_tool_call WHERE tool_call_id IS NOT NULL GROUP BY 1""",
    }
