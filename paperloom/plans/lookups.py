"""Queries that look up, match, compare and check rows of several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as T
from paperloom.operators import layout as L
from paperloom.operators.hierarchy import hierarchy, latest_rows
from paperloom.operators.nested import linked, node_table
from paperloom.operators.retrieval import containing
from paperloom.operators.sequences import number_rows
from paperloom.session import table
from paperloom.staging import stage

#: Words that name nothing.
STOP_WORDS = "the a an of for in on with and to from by at is are its via using study".split()
#: Budgets of a run, and needs of a request.
MOST_CALLS, MOST_SECONDS, MOST_NEEDS = 12, 900, 6
PAPER = ["id", "title", "year", "reading_status", "folder_id"]


def lib_paper(spark: SparkSession, folder: str) -> DataFrame:
    """One paper by its key; the filter reaches the scan."""
    return table(spark, folder, "paper").filter("id = 7").select(*PAPER)


def lib_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Papers by a list of keys, in the order of the list; keys that lead nowhere give nothing."""
    ids = [41, 7, 300, 12, 7, 999_999_999]
    place = F.array_position(F.array(*[F.lit(i).cast("bigint") for i in ids]), F.col("id"))
    return table(spark, folder, "paper").filter(F.col("id").isin(ids)).select(*PAPER, place.cast("int").alias("place"))


def lib_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty papers read last, newest first: the pseudo-folder of recent ones."""
    top = table(spark, folder, "paper").filter("last_read_at is not null").select("id", "last_read_at").orderBy(F.desc("last_read_at"), "id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_read_at"), "id"))).select("id", "place")


def lib_csv_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of the folders that a comma-separated text names; parts that are no number are left out."""
    wanted = F.transform(F.split(F.lit("109, 461,x,,7, 13 "), ","), lambda p: F.trim(p).try_cast("bigint"))
    return table(spark, folder, "paper").filter(F.coalesce(F.array_contains(F.array_compact(wanted), F.col("folder_id")), F.lit(False))).groupBy("folder_id").agg(F.count("*").alias("papers"))


def lib_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Folders numbered within their parent by sort order, then id."""
    f = latest_rows(table(spark, folder, "folder"), "id", "updated_at", ["parent_id", "name", "sort_order"])
    return number_rows(f.select("id", "parent_id", "sort_order"), ["parent_id"], [F.col("sort_order").asc_nulls_first(), F.col("id").asc()], "place").select("id", "parent_id", "place")


def lib_document_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their papers, numbered within their source in order of time; a source may have any number."""
    d = table(spark, folder, "documents").filter("paper_id is not null and source is not null").select("doc_id", "source", "paper_id", "created_at")
    joined = d.join(table(spark, folder, "paper").select(F.col("id").alias("paper_id"), "year"), "paper_id")
    return number_rows(joined, ["source"], [F.col("created_at").asc_nulls_first(), F.col("doc_id").asc()], "place").select("source", "place", "doc_id", "paper_id", "year")


def lib_paper_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of every paper's documents, the one with most documents first."""
    d = table(spark, folder, "documents").filter("paper_id is not null and source is not null").groupBy("paper_id", "source").agg(F.count("*").alias("documents"))
    return number_rows(d, ["paper_id"], [F.desc("documents"), F.asc("source")], "place").select("paper_id", "place", "source", "documents")


def lib_folder_match(spark: SparkSession, folder: str) -> DataFrame:
    """The folder whose name a paper's title has: the longest and deepest (length of the name + 3 for each level), then the
    least id. Names are looked for by an automaton over blocks of names, not paper by paper."""
    tree = hierarchy(table(spark, folder, "folder"), paths=False).select("id", "depth", F.lower(T.collapsed(F.col("name"))).alias("name")).filter("length(name) >= 3")
    names = stage(tree)
    titles = table(spark, folder, "paper").select(F.col("id").alias("source_id"), F.lit(0).alias("page"), F.lit("").alias("kind"), F.lower(T.collapsed(F.col("title"))).alias("title"))
    found = containing(names.select("name").distinct(), titles, ["title"]).join(names, F.col("found") == F.col("name"))
    score = F.length("name") + 3 * F.col("depth")
    best = found.groupBy("source_id").agg(F.min(F.struct((-score).alias("s"), "id")).alias("m"))
    return best.select(F.col("source_id").alias("paper_id"), F.col("m.id").alias("folder_id"), (-F.col("m.s")).cast("bigint").alias("score"))


def lib_fallback_names(spark: SparkSession, folder: str) -> DataFrame:
    """A folder name for every paper without a folder: the first three words of the title that name something."""
    words = F.filter(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(STOP_WORDS))
    return table(spark, folder, "paper").filter("folder_id is null").select("id", F.array_join(F.slice(words, 1, 3), " ").alias("name"))


def run_active(spark: SparkSession, folder: str) -> DataFrame:
    """The newest call of every run that is still open."""
    c = table(spark, folder, "agent_tool_call").filter("run_id is not null and status in ('REQUESTED', 'RUNNING')")
    return c.groupBy("run_id").agg(F.max_by(F.struct("id", "tool_name", "ordinal_no"), F.struct("ordinal_no", "id")).alias("m")).select("run_id", "m.id", "m.tool_name", "m.ordinal_no")


def run_spoken(spark: SparkSession, folder: str) -> DataFrame:
    """Finished calls of runs in which some message followed the call's end: a semi-join on the run's last message."""
    last = table(spark, folder, "research_message").filter("run_id is not null").groupBy("run_id").agg(F.max("created_at").alias("last_at"))
    c = table(spark, folder, "agent_tool_call").filter("status = 'SUCCEEDED' and run_id is not null and completed_at is not null").select("run_id", "id", "tool_name", "completed_at")
    return c.join(last, "run_id").filter("last_at > completed_at").select("run_id", "id", "tool_name")


def run_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What every call that returned sources brought its run: sources, new ones among them, and the outcome
    (``new_sources``, ``same_sources``): set difference with what earlier calls of the run returned."""
    calls = table(spark, folder, "agent_tool_call").filter("run_id is not null and result_json is not null")
    nodes = node_table(calls, "id", "result_json", ["sources"], "sourceId").filter("kind = 'object' and value is not null")
    got = nodes.select(F.col("record_id").alias("id"), F.col("value").alias("source")).distinct().join(calls.select("id", "run_id", "ordinal_no"), "id")
    first = got.groupBy("run_id", "source").agg(F.min(F.struct("ordinal_no", "id")).alias("f"))
    marked = got.join(first, ["run_id", "source"]).groupBy("run_id", "id").agg(F.count("*").alias("sources"), F.count_if(F.col("f.id") == F.col("id")).alias("new"))
    return marked.withColumn("outcome", F.when(F.col("new") > 0, "new_sources").otherwise("same_sources"))


def run_timeouts(spark: SparkSession, folder: str) -> DataFrame:
    """Why every run with a failed call stopped: its last failed call decides; one that was never sent hit a limit."""
    c = table(spark, folder, "agent_tool_call").filter("run_id is not null and status = 'FAILED'")
    last = c.groupBy("run_id").agg(F.max_by(F.struct("ordinal_no", "error_code", "id"), F.struct("ordinal_no", "id")).alias("m"))
    why = F.when(F.col("m.error_code").isNotNull(), "RUN_TIMEOUT").when(F.col("m.ordinal_no") > MOST_CALLS, "AGENT_CALL_LIMIT").otherwise("CONTEXT_BUDGET_EXCEEDED")
    return last.select("run_id", F.col("m.id").alias("id"), why.alias("reason"))


def run_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and seconds of every run, and whether either is over its budget."""
    c = table(spark, folder, "agent_tool_call").filter("run_id is not null")
    g = c.groupBy("run_id").agg(F.count("*").alias("calls"), F.coalesce(F.timestamp_diff("SECOND", F.min("started_at"), F.max("completed_at")), F.lit(0)).cast("bigint").alias("seconds"))
    return g.withColumn("over", (F.col("calls") > MOST_CALLS) | (F.col("seconds") > MOST_SECONDS))


def run_issues(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the needs of every call, as rows: no query, no target, or more needs than allowed."""
    calls = table(spark, folder, "agent_tool_call")
    nodes = stage(node_table(calls, "id", "arguments_json", ["needs", "targets"], "query").filter("kind not in ('array', 'null')"))
    is_need = (F.col("name") == "needs") & (F.col("kind") == "object")
    needs = nodes.filter(is_need).select("record_id", "row_no", "pre", F.col("list_pos").alias("need_no"), "value")
    aimed = linked(nodes, is_need, (F.col("name") == "targets") & (F.col("kind") == "scalar"), ["record_id", "row_no"]).select("record_id", "row_no", F.col("parent_pre").alias("pre")).distinct().withColumn("aimed", F.lit(True))
    own = needs.join(aimed, ["record_id", "row_no", "pre"], "left")
    codes = F.array_compact(F.array(F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "QUERY_MISSING"), F.when(F.col("aimed").isNull(), "TARGETS_MISSING")))
    single = own.select(F.col("record_id").alias("call_id"), F.col("need_no").cast("int").alias("need_no"), F.explode(codes).alias("code"))
    many = needs.groupBy("record_id").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_NEEDS).select(F.col("record_id").alias("call_id"), F.lit(None).cast("int").alias("need_no"), F.lit("TOO_MANY_NEEDS").alias("code"))
    return single.unionByName(many)


def doc_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Headings by the level that their numbering tells: parts of a dotted number (at most 6), a letter 2, a Roman number
    1; null without numbering."""
    b = L.layout_blocks(table(spark, folder, "paper_layout_artifact")).filter("role = 'HEADING'")
    number = F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)\.?\s", 1)
    level = F.when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\.")))).when(F.col("text").rlike(r"^\s*[IVXLC]+\.?\s"), 1).when(F.col("text").rlike(r"^\s*[A-Z]\.?\s"), 2)
    return b.groupBy("artifact_id", level.alias("level")).agg(F.count("*").alias("headings"))


def doc_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Five blocks of every artifact as local evidence: those in the upper half of page 1 first, then by confidence; given
    in reading order."""
    b = L.layout_blocks(table(spark, folder, "paper_layout_artifact")).filter("trim(text) != ''")
    chosen = F.when((F.col("page") == 1) & (F.col("y") < 0.5), 0).otherwise(1)
    w = Window.partitionBy("artifact_id").orderBy(chosen, F.desc("confidence"), "ord", "block_id")
    five = b.withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return five.withColumn("place", F.row_number().over(Window.partitionBy("artifact_id").orderBy("ord", "block_id"))).select("artifact_id", "block_id", "place")


def doc_uncaptioned(spark: SparkSession, folder: str) -> DataFrame:
    """Captions that stand under no structured table or formula: an anti-join."""
    b = L.layout_blocks(table(spark, folder, "paper_layout_artifact"))
    captions = b.filter("role = 'CAPTION'")
    held = L.nearest_above(captions, b.filter("role in ('TABLE', 'FORMULA') and mode = 'STRUCTURED'"), 0.3).filter("other_id is not null")
    return captions.select("artifact_id", "block_id").join(held.select("artifact_id", "block_id"), ["artifact_id", "block_id"], "left_anti")


def doc_display(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of displays: formulas of one lane of a page that stand at most 0.028 below all before them, as one box."""
    b = L.layout_blocks(table(spark, folder, "paper_layout_artifact")).filter(G.valid(G.box()) & (F.col("role") == "FORMULA")).withColumn("lane", G.lane(F.col("page"), G.box()))
    w = Window.partitionBy("artifact_id", "page", "lane").orderBy("y", "x", "block_id")
    far = F.coalesce(F.col("y") - F.max(F.col("y") + F.col("h")).over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0.028, F.lit(True))
    islands = b.withColumn("far", far).withColumn("box", F.sum(F.col("far").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return islands.groupBy("artifact_id", "page", "lane", "box").agg(
        F.count("*").alias("blocks"), F.round(F.min("x"), 6).alias("x0"), F.round(F.min("y"), 6).alias("y0"), F.round(F.max(F.col("x") + F.col("w")), 6).alias("x1"), F.round(F.max(F.col("y") + F.col("h")), 6).alias("y1")
    )


def doc_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Memories by schema and status: how many have a sound structure and a sound profile, and the share that has both."""
    m = table(spark, folder, "paper_memory").select("schema_version", "status", F.try_parse_json("structure_json").isNotNull().alias("s"), F.try_parse_json("profile_json").isNotNull().alias("p"))
    return m.groupBy("schema_version", "status").agg(F.count("*").alias("memories"), F.count_if("s").alias("structures"), F.count_if("p").alias("profiles"), F.round(F.avg((F.col("s") & F.col("p")).cast("double")), 6).alias("valid"))


def eve_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the documents are a sound set of cases: rows, distinct ids, blank texts, wrong lengths, papers that are not
    there, in one row."""
    d = table(spark, folder, "documents")
    known = table(spark, folder, "paper").select(F.col("id").alias("paper_id"), F.lit(True).alias("there"))
    j = d.join(known, "paper_id", "left")
    return j.agg(
        F.count("*").alias("cases"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"),
        F.count_if(F.coalesce(F.length("text") != F.col("n_chars"), F.lit(False))).alias("wrong_length"), F.count_if(F.col("paper_id").isNotNull() & F.col("there").isNull()).alias("strangers"),
    )


def eve_eligible(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the first reason that keeps them out of an evaluation, or none."""
    t = F.trim("text")
    why = F.when(F.coalesce(t, F.lit("")) == "", "NO_TEXT").when(F.col("paper_id").isNull(), "NO_PAPER").when(F.coalesce(F.trim("lang"), F.lit("")) == "", "NO_LANGUAGE").when(F.length("text") < 40, "TOO_SHORT")
    return table(spark, folder, "documents").groupBy("doc_kind", why.alias("reason")).agg(F.count("*").alias("documents"))


def txt_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with keys or tokens in them, by type, and the characters left once those are masked."""
    m = table(spark, folder, "research_message").filter("content is not null").select("message_type", "content", T.redacted(F.col("content")).alias("masked"))
    return m.groupBy("message_type").agg(F.count("*").alias("messages"), F.count_if(F.col("masked") != F.col("content")).alias("masked"), F.sum(F.length("masked")).cast("bigint").alias("characters"))


def queries() -> dict:
    """The queries of this module."""
    return {n: f for n, f in globals().items() if n.startswith(("lib_", "run_", "doc_", "eve_", "txt_"))}


def oracle_sql() -> dict[str, str]:
    """DuckDB texts with the same results; run_sources reads wrapped JSON and is tested by brute force."""
    from paperloom.plans.documents import _B
    from paperloom.plans.hierarchy import _LATEST
    from paperloom.plans.retrieval import NEEDS_SQL

    paper = ", ".join(PAPER)
    collapsed = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return {
        "lib_paper": f"SELECT {paper} FROM paper WHERE id = 7",
        "lib_by_ids": f"SELECT {paper}, CAST(list_position([41, 7, 300, 12, 7, 999999999], id) AS INTEGER) AS place FROM paper WHERE id IN (41, 7, 300, 12, 999999999)",
        "lib_recent": "SELECT id, CAST(row_number() OVER (ORDER BY last_read_at DESC, id) AS INTEGER) AS place FROM paper WHERE last_read_at IS NOT NULL QUALIFY place <= 20",
        "lib_csv_folders": "SELECT folder_id, count(*) AS papers FROM paper WHERE folder_id IN (SELECT try_cast(trim(x, ' ') AS BIGINT) FROM (SELECT unnest(str_split('109, 461,x,,7, 13 ', ',')) AS x) WHERE try_cast(trim(x, ' ') AS BIGINT) IS NOT NULL) GROUP BY folder_id",
        "lib_folders": f"WITH {_LATEST} SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order NULLS FIRST, id) AS place FROM latest",
        "lib_document_papers": "SELECT d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.created_at NULLS FIRST, d.doc_id) AS place, d.doc_id, d.paper_id, p.year FROM documents d JOIN paper p ON p.id = d.paper_id WHERE d.source IS NOT NULL",
        "lib_paper_sources": "SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, source) AS place, source, n AS documents FROM (SELECT paper_id, source, count(*) AS n FROM documents WHERE paper_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL)",
        "lib_folder_match": f"""WITH RECURSIVE {_LATEST}, down AS (SELECT id, 0 AS depth, name FROM latest WHERE parent_id IS NULL UNION ALL SELECT l.id, d.depth + 1, l.name FROM latest l JOIN down d ON l.parent_id = d.id),
n AS (SELECT id, depth, lower({collapsed.format('name')}) AS name FROM down), m AS (SELECT p.id AS paper_id, n.id AS folder_id, length(n.name) + 3 * depth AS score FROM paper p JOIN n ON length(n.name) >= 3 AND contains(lower({collapsed.format('p.title')}), n.name))
SELECT paper_id, folder_id, CAST(score AS BIGINT) AS score FROM m QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, folder_id) = 1""",
        "lib_fallback_names": f"SELECT id, array_to_string(list_slice(list_filter(regexp_extract_all(coalesce(title, ''), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: length(w) >= 3 AND lower(w) NOT IN ({stops})), 1, 3), ' ') AS name FROM paper WHERE folder_id IS NULL",
        "run_active": "SELECT run_id, id, tool_name, ordinal_no FROM agent_tool_call WHERE run_id IS NOT NULL AND status IN ('REQUESTED', 'RUNNING') QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ordinal_no DESC NULLS LAST, id DESC) = 1",
        "run_spoken": "SELECT run_id, id, tool_name FROM agent_tool_call c WHERE status = 'SUCCEEDED' AND completed_at IS NOT NULL AND EXISTS (SELECT 1 FROM research_message m WHERE m.run_id = c.run_id AND m.created_at > c.completed_at)",
        "run_timeouts": f"""SELECT run_id, id, CASE WHEN error_code IS NOT NULL THEN 'RUN_TIMEOUT' WHEN ordinal_no > {MOST_CALLS} THEN 'AGENT_CALL_LIMIT' ELSE 'CONTEXT_BUDGET_EXCEEDED' END AS reason
FROM agent_tool_call WHERE run_id IS NOT NULL AND status = 'FAILED' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ordinal_no DESC NULLS LAST, id DESC) = 1""",
        "run_budgets": f"""SELECT run_id, calls, seconds, calls > {MOST_CALLS} OR seconds > {MOST_SECONDS} AS over FROM (SELECT run_id, count(*) AS calls, coalesce(date_sub('second', min(started_at), max(completed_at)), 0) AS seconds
FROM agent_tool_call WHERE run_id IS NOT NULL GROUP BY run_id)""",
        "run_issues": f"""WITH {NEEDS_SQL.replace(' WHERE id % 20 = 0', '')}, n AS (SELECT call_id, CAST(need_no AS INTEGER) AS need_no, n ->> 'query' AS query, n -> 'targets' AS t FROM nd WHERE json_type(n) = 'OBJECT'),
a AS (SELECT *, CASE WHEN json_type(t) = 'ARRAY' THEN len(list_filter(CAST(t AS JSON[]), lambda x: json_type(x) <> 'NULL')) > 0 ELSE coalesce(json_type(t) <> 'NULL', false) END AS aimed FROM n)
SELECT call_id, need_no, 'QUERY_MISSING' AS code FROM a WHERE trim(coalesce(query, ''), ' ') = '' UNION ALL SELECT call_id, need_no, 'TARGETS_MISSING' FROM a WHERE NOT aimed
UNION ALL SELECT call_id, NULL, 'TOO_MANY_NEEDS' FROM a GROUP BY call_id HAVING count(*) > {MOST_NEEDS}""",
        "doc_levels": f"""WITH {_B}, h AS (SELECT artifact_id, text, regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)\\.?\\s', 1) AS no FROM blocks WHERE role = 'HEADING')
SELECT artifact_id, CAST(CASE WHEN no <> '' THEN least(6, len(str_split(no, '.'))) WHEN regexp_matches(text, '^\\s*[IVXLC]+\\.?\\s') THEN 1 WHEN regexp_matches(text, '^\\s*[A-Z]\\.?\\s') THEN 2 END AS INTEGER) AS level, count(*) AS headings FROM h GROUP BY ALL""",
        "doc_evidence": f"""WITH {_B}, f AS (SELECT artifact_id, block_id, ord FROM blocks WHERE trim(text, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY CASE WHEN page = 1 AND y < 0.5 THEN 0 ELSE 1 END, confidence DESC, ord, block_id) <= 5)
SELECT artifact_id, block_id, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY ord, block_id) AS INTEGER) AS place FROM f""",
        "doc_uncaptioned": f"""WITH {_B} SELECT artifact_id, block_id FROM blocks c WHERE role = 'CAPTION' AND NOT EXISTS (SELECT 1 FROM blocks o WHERE o.artifact_id = c.artifact_id AND o.page = c.page AND o.role IN ('TABLE', 'FORMULA') AND o.mode = 'STRUCTURED'
  AND least(c.x + c.w, o.x + o.w) > greatest(c.x, o.x) AND c.y - (o.y + o.h) BETWEEN -0.01 AND 0.3)""",
        "doc_display": f"""WITH {_B}, f AS (SELECT *, coalesce(y - max(y + h) OVER (PARTITION BY artifact_id, page, lane ORDER BY y, x, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.028, true) AS far FROM boxed WHERE valid AND role = 'FORMULA'),
i AS (SELECT *, CAST(sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id, page, lane ORDER BY y, x, block_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS box FROM f)
SELECT artifact_id, page, lane, box, count(*) AS blocks, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x + w), 6) AS x1, round(max(y + h), 6) AS y1 FROM i GROUP BY ALL""",
        "doc_validity": """SELECT schema_version, status, count(*) AS memories, count(*) FILTER (json_valid(structure_json)) AS structures, count(*) FILTER (json_valid(profile_json)) AS profiles,
round(avg(CASE WHEN json_valid(structure_json) AND json_valid(profile_json) THEN 1.0 ELSE 0.0 END), 6) AS valid FROM paper_memory GROUP BY ALL""",
        "eve_integrity": """SELECT count(*) AS cases, count(DISTINCT doc_id) AS ids, count(*) FILTER (trim(coalesce(text, ''), ' ') = '') AS blank, count(*) FILTER (length(text) <> n_chars) AS wrong_length,
count(*) FILTER (paper_id IS NOT NULL AND paper_id NOT IN (SELECT id FROM paper)) AS strangers FROM documents""",
        "eve_eligible": """SELECT doc_kind, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'NO_TEXT' WHEN paper_id IS NULL THEN 'NO_PAPER' WHEN trim(coalesce(lang, ''), ' ') = '' THEN 'NO_LANGUAGE' WHEN length(text) < 40 THEN 'TOO_SHORT' END AS reason,
count(*) AS documents FROM documents GROUP BY ALL""",
        "txt_redacted": """WITH m AS (SELECT message_type, content, regexp_replace(regexp_replace(content, '(?i)(bearer\\s+)[A-Za-z0-9._~+/=-]+', '\\1***', 'g'), '(?i)((?:api[_-]?key|token|secret|password)\\s*[=:]\\s*)[^\\s,;&]+', '\\1***', 'g') AS masked FROM research_message WHERE content IS NOT NULL)
SELECT message_type, count(*) AS messages, count(*) FILTER (masked <> content) AS masked, CAST(sum(length(masked)) AS BIGINT) AS characters FROM m GROUP BY message_type""",
    }
