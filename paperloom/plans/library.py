"""Library queries over papers and folders: lists, counts, tags, progress, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import metadata as M
from paperloom.operators import rows as R
from paperloom.operators.hierarchy import latest_rows, subtree_sums
from paperloom.session import table

#: Sort keys that callers may name, with their columns.
SORTS = {"title": "title", "year": "year", "created": "created_at"}


def matches_keyword(columns: list[str], keyword: str, escape: bool = True) -> Column:
    """Case-insensitive containment in any column. With ``escape`` the keyword is literal, else % and _ in it are
    wildcards."""
    text = keyword
    if escape:
        for c in "\\%_":
            text = text.replace(c, "\\" + c)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return hit


def library(papers: DataFrame, keyword: str | None = None, statuses: list[str] | None = None, folders: list[int] | None = None, uncategorised: bool = False, tag: str | None = None) -> DataFrame:
    """Papers that pass every given filter. Folder and uncategorised are alternatives; a tag is a semi-join on the
    exploded keywords, so no row comes twice."""
    out = papers
    if keyword:
        out = out.filter(matches_keyword(["title", "authors", "keywords", "doi"], keyword))
    if statuses:
        out = out.filter(F.upper(F.trim("reading_status")).isin(statuses))
    if uncategorised:
        out = out.filter(F.col("folder_id").isNull())
    elif folders is not None:
        out = out.filter(F.col("folder_id").isin(folders))
    if tag:
        out = out.join(M.tags(papers, "id", "keywords").filter(F.col("tag") == tag).select("id"), "id", "left_semi")
    return out


def sorted_by(sort: str, descending: bool) -> list[Column]:
    """Pinned first, then the named sort (others fall back to created), then id, so pages are stable."""
    c = F.col(SORTS.get(sort, "created_at"))
    return [F.coalesce("pinned", F.lit(False)).desc(), c.desc_nulls_last() if descending else c.asc_nulls_first(), F.col("id").desc() if descending else F.col("id").asc()]


def lib_list(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of 25 of the papers that mention graphs and are being read or read, by title."""
    found = library(table(spark, folder, "paper"), keyword="graph", statuses=["READ", "READING"])
    return R.page(found, sorted_by("title", False), 2, 25).select("id", "title", "year", "reading_status", "pinned")


def lib_list_size(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and pages of the list."""
    found = library(table(spark, folder, "paper"), keyword="graph", statuses=["READ", "READING"])
    return found.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 25).cast("bigint").alias("pages"))


def lib_after_key(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 papers after the middle of the library in order of reading time, by keyset."""
    papers = table(spark, folder, "paper").select("id", "read_seconds", "title")
    return R.after_key(papers, "read_seconds", "id", (1000, 0), 50)


def lib_uncategorised(spark: SparkSession, folder: str) -> DataFrame:
    """Papers without a folder or in one that is gone."""
    papers = table(spark, folder, "paper").select("id", "title", "folder_id")
    ids = table(spark, folder, "folder").select(F.col("id").alias("folder_id")).distinct()
    gone = papers.filter("folder_id is not null").join(ids, "folder_id", "left_anti").select("id", "title", "folder_id", F.lit("gone").alias("reason"))
    return gone.unionByName(papers.filter("folder_id is null").withColumn("reason", F.lit("none")))


def lib_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with a tag, by semi-join."""
    return library(table(spark, folder, "paper"), tag="claim graph").select("id", "title")


def lib_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of every paper in order of first appearance, none twice; papers without tags have an empty list."""
    return table(spark, folder, "paper").select("id", F.coalesce(F.array_join(M.tag_list("keywords"), "|"), F.lit("")).alias("tags"))


def lib_tag_links(spark: SparkSession, folder: str) -> DataFrame:
    """(id, position, tag): links with their place."""
    return M.tags(table(spark, folder, "paper"), "id", "keywords")


def lib_tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Papers and reading time per tag."""
    papers = table(spark, folder, "paper").select("id", "keywords", "read_seconds")
    return M.tags(papers, "id", "keywords").join(papers, "id").groupBy("tag").agg(F.count("*").alias("papers"), F.sum("read_seconds").alias("seconds"))


def lib_folder_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Papers per folder that has any."""
    return table(spark, folder, "paper").filter("folder_id is not null").groupBy("folder_id").agg(F.count("*").alias("papers"))


def lib_folder_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Papers in each sound folder and all below it: counts are summed upward over the tree."""
    own = latest_rows(table(spark, folder, "folder"), "id", "updated_at", ["parent_id", "name", "sort_order"]).select("id", F.col("parent_id").alias("parent"))
    return subtree_sums(own.join(lib_folder_counts(spark, folder), F.col("id") == F.col("folder_id"), "left"), ("papers",))


def lib_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """All counts of the overview in one pass; the month is that of the newest paper."""
    papers = table(spark, folder, "paper").select("reading_status", "folder_id", "pinned", "created_at")
    status = F.upper(F.trim("reading_status"))
    month = papers.agg(F.date_trunc("month", F.max("created_at"))).scalar()
    return papers.agg(
        F.count("*").alias("total"),
        *[F.count_if(status == s).alias(s.lower()) for s in ("UNREAD", "READING", "READ")],
        F.count_if(F.col("folder_id").isNull()).alias("no_folder"),
        F.count_if(F.col("pinned")).alias("pinned"),
        F.count_if(F.col("created_at") >= month).alias("this_month"),
    )


def lib_status(spark: SparkSession, folder: str) -> DataFrame:
    """Reading status in one spelling, with how many rows had to be changed or can't be read."""
    s = F.upper(F.trim("reading_status"))
    ok = s.isin("UNREAD", "READING", "READ")
    return table(spark, folder, "paper").groupBy(F.when(ok, s).alias("status")).agg(F.count("*").alias("papers"), F.count_if(ok & (s != F.col("reading_status"))).alias("changed"))


def lib_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that break a limit, one row for each limit."""
    checks = {
        "authors_long": F.length("authors") > 60, "doi_form": ~F.col("doi").rlike(r"^10\.\d+/\S+$"), "pages": F.col("current_page") > F.col("page_count"),
        "title_blank": F.coalesce(F.trim("title"), F.lit("")) == "", "source_blank": F.coalesce(F.trim("source"), F.lit("")) == "", "year": (F.col("year") < 1900) | (F.col("year") > 2099),
    }
    return R.violations(table(spark, folder, "paper"), "id", checks)


def lib_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Percent read, floored and at most 100; null without a page count."""
    pages = F.col("page_count")
    return table(spark, folder, "paper").select("id", F.when(pages > 0, F.least(F.lit(100), F.expr("current_page * 100L div page_count"))).cast("bigint").alias("percent"))


def lib_backlog(spark: SparkSession, folder: str) -> DataFrame:
    """The five sources with most unread papers, and their percent of the first."""
    unread = table(spark, folder, "paper").filter("upper(trim(reading_status)) = 'UNREAD'").groupBy(R.first_text("source").alias("source")).agg(F.count("*").alias("papers"))
    best = unread.filter("source is not null").orderBy(F.desc("papers"), F.asc("source")).limit(5)
    return best.select("source", "papers", F.floor(F.col("papers") * 100 / F.max("papers").over(Window.partitionBy()) + 0.5).cast("bigint").alias("percent"))


def lib_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every paper with its duplicate class (by DOI, else by a hash of title and authors), the class being its least
    id, and the class's size."""
    papers = table(spark, folder, "paper").select("id", "doi", "title", "authors")
    doi = M.bare_doi(F.col("doi"))
    key = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("sha:"), F.sha2(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("authors", F.lit(""))), 256)))
    keyed = papers.select("id", key.alias("key"))
    classes = keyed.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return keyed.join(classes, "key").select("id", "class_id", "copies")


def lib_doi(spark: SparkSession, folder: str) -> DataFrame:
    """DOIs without resolver, label and case, with their registrant."""
    doi = M.bare_doi(F.col("doi"))
    return table(spark, folder, "paper").select("id", doi.alias("doi"), F.regexp_extract(doi, r"^(10\.\d+)/", 1).alias("registrant"))


def lib_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Authors as a list of records (name, role), as JSON text; null and blank fields give an empty list."""
    return table(spark, folder, "paper").select("id", M.author_json(F.col("authors")).alias("authors_json"))


def lib_author_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Entries per paper: how many papers have how many authors."""
    n = F.size(M.author_list(F.col("authors")))
    return table(spark, folder, "paper").groupBy(n.cast("bigint").alias("authors")).agg(F.count("*").alias("papers"))


def lib_months(spark: SparkSession, folder: str) -> DataFrame:
    """Papers, pages and mean reading time per month of arrival."""
    return table(spark, folder, "paper").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("papers"), F.sum("page_count").alias("pages"), F.round(F.avg("read_seconds"), 4).alias("mean_seconds"), F.max("read_seconds").cast("bigint").alias("most_seconds")
    )


def lib_folder_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The current state of every folder."""
    rows = table(spark, folder, "folder").select("id", "name", "parent_id", "sort_order", "updated_at")
    return R.latest_per_key(rows, ["id"], ["updated_at"]).select("id", "name", "parent_id", "sort_order")


def lib_children(spark: SparkSession, folder: str) -> DataFrame:
    """Folders per parent, with the first and last name."""
    now = lib_folder_latest(spark, folder)
    return now.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def lib_reroot(spark: SparkSession, folder: str) -> DataFrame:
    """Folders after the deletion of every folder named like a draft: their children become top level."""
    now = lib_folder_latest(spark, folder)
    gone = now.filter("lower(name) like '%draft%'").select(F.col("id").alias("gone_id"))
    left = now.join(gone, F.col("id") == F.col("gone_id"), "left_anti").join(gone, F.col("parent_id") == F.col("gone_id"), "left")
    return left.select("id", F.when(F.col("gone_id").isNull(), F.col("parent_id")).alias("parent_id"))


def queries() -> dict:
    """The queries of this module."""
    return {n: f for n, f in globals().items() if n.startswith("lib_")}


_TAGS = """tags AS (SELECT id, min(position) AS position, tag FROM (
  SELECT id, trim(x) AS tag, row_number() OVER () AS position FROM (SELECT id, unnest(regexp_split_to_array(keywords, '[,;，；]')) AS x FROM paper)) WHERE tag <> '' GROUP BY id, tag)"""
_DOI = "nullif(lower(regexp_replace(trim(doi), '^(?i:https?://[^/]+/|doi:\\s*)', '')), '')"
_LATEST = "latest AS (SELECT id, name, parent_id, sort_order FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, name DESC NULLS LAST, parent_id DESC NULLS LAST, sort_order DESC NULLS LAST) AS rn FROM folder) WHERE rn = 1)"
_LIST = """lower(coalesce(title, '') || chr(1) || coalesce(authors, '') || chr(1) || coalesce(keywords, '') || chr(1) || coalesce(doi, '')) LIKE '%graph%'
  AND upper(trim(reading_status)) IN ('READ', 'READING')"""
_AUTHORS = "list_filter(list_transform(CASE WHEN contains(authors, ';') THEN str_split(authors, ';') ELSE str_split(authors, ',') END, lambda x: trim(x)), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    """DuckDB texts with the same results."""
    return {
        "lib_list": f"SELECT id, title, year, reading_status, pinned FROM paper WHERE {_LIST} ORDER BY coalesce(pinned, false) DESC, title ASC NULLS FIRST, id LIMIT 25 OFFSET 25",
        "lib_list_size": f"SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM paper WHERE {_LIST}",
        "lib_after_key": "SELECT id, read_seconds, title FROM paper WHERE read_seconds < 1000 OR read_seconds = 1000 AND id < 0 ORDER BY read_seconds DESC, id DESC LIMIT 50",
        "lib_uncategorised": """SELECT id, title, folder_id, CASE WHEN folder_id IS NULL THEN 'none' ELSE 'gone' END AS reason FROM paper
WHERE folder_id IS NULL OR NOT EXISTS (SELECT 1 FROM folder f WHERE f.id = paper.folder_id)""",
        "lib_tagged": f"WITH {_TAGS} SELECT id, title FROM paper WHERE id IN (SELECT id FROM tags WHERE tag = 'claim graph')",
        "lib_tags": f"WITH {_TAGS} SELECT p.id, coalesce(string_agg(t.tag, '|' ORDER BY t.position), '') AS tags FROM paper p LEFT JOIN tags t ON p.id = t.id GROUP BY p.id",
        "lib_tag_links": f"WITH {_TAGS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY position) - 1 AS INTEGER) AS position, tag FROM tags",
        "lib_tag_counts": f"WITH {_TAGS} SELECT tag, count(*) AS papers, CAST(sum(read_seconds) AS BIGINT) AS seconds FROM tags JOIN paper USING (id) GROUP BY tag",
        "lib_folder_counts": "SELECT folder_id, count(*) AS papers FROM paper WHERE folder_id IS NOT NULL GROUP BY folder_id",
        "lib_folder_totals": f"""WITH RECURSIVE {_LATEST}, down AS (SELECT id FROM latest WHERE parent_id IS NULL UNION SELECT l.id FROM latest l JOIN down d ON l.parent_id = d.id),
up AS (SELECT id, id AS top, parent_id FROM latest WHERE id IN (SELECT id FROM down) UNION ALL SELECT u.id, l.id, l.parent_id FROM up u JOIN latest l ON u.parent_id = l.id)
SELECT d.id, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS papers FROM down d LEFT JOIN up u ON u.top = d.id
LEFT JOIN (SELECT folder_id, count(*) AS n FROM paper GROUP BY folder_id) c ON c.folder_id = u.id GROUP BY d.id""",
        "lib_dashboard": """SELECT count(*) AS total, count(*) FILTER (upper(trim(reading_status)) = 'UNREAD') AS unread, count(*) FILTER (upper(trim(reading_status)) = 'READING') AS reading,
count(*) FILTER (upper(trim(reading_status)) = 'READ') AS read, count(*) FILTER (folder_id IS NULL) AS no_folder, count(*) FILTER (pinned) AS pinned,
count(*) FILTER (created_at >= (SELECT date_trunc('month', max(created_at)) FROM paper)) AS this_month FROM paper""",
        "lib_status": """SELECT CASE WHEN s IN ('UNREAD', 'READING', 'READ') THEN s END AS status, count(*) AS papers,
count(*) FILTER (s IN ('UNREAD', 'READING', 'READ') AND s <> reading_status) AS changed FROM (SELECT *, upper(trim(reading_status)) AS s FROM paper) GROUP BY 1""",
        "lib_violations": """SELECT id, 'authors_long' AS violation FROM paper WHERE length(authors) > 60
UNION ALL SELECT id, 'doi_form' FROM paper WHERE NOT regexp_matches(doi, '^10\\.\\d+/\\S+$') UNION ALL SELECT id, 'pages' FROM paper WHERE current_page > page_count
UNION ALL SELECT id, 'title_blank' FROM paper WHERE coalesce(trim(title), '') = '' UNION ALL SELECT id, 'source_blank' FROM paper WHERE coalesce(trim(source), '') = ''
UNION ALL SELECT id, 'year' FROM paper WHERE year < 1900 OR year > 2099""",
        "lib_progress": "SELECT id, CASE WHEN page_count > 0 THEN least(100, CAST(current_page AS BIGINT) * 100 // page_count) END AS percent FROM paper",
        "lib_backlog": """WITH b AS (SELECT trim(source) AS source, count(*) AS papers FROM paper WHERE upper(trim(reading_status)) = 'UNREAD' AND trim(source) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT source, papers, CAST(floor(papers * 100.0 / (SELECT max(papers) FROM b) + 0.5) AS BIGINT) AS percent FROM b""",
        "lib_duplicates": f"""WITH k AS (SELECT id, coalesce('doi:' || {_DOI}, 'sha:' || sha256(coalesce(title, '') || '|' || coalesce(authors, ''))) AS key FROM paper)
SELECT id, min(id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS copies FROM k""",
        "lib_doi": f"SELECT id, {_DOI} AS doi, regexp_extract({_DOI}, '^(10\\.\\d+)/', 1) AS registrant FROM paper",
        "lib_authors": f"SELECT id, coalesce(CAST(to_json(list_transform({_AUTHORS}, lambda x: {{'name': x, 'role': 'author'}})) AS VARCHAR), '[]') AS authors_json FROM paper",
        "lib_author_counts": f"SELECT CAST(coalesce(len({_AUTHORS}), 0) AS BIGINT) AS authors, count(*) AS papers FROM paper GROUP BY 1",
        "lib_months": """SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS papers, CAST(sum(page_count) AS BIGINT) AS pages, round(avg(read_seconds), 4) AS mean_seconds,
CAST(max(read_seconds) AS BIGINT) AS most_seconds FROM paper GROUP BY 1""",
        "lib_folder_latest": f"WITH {_LATEST} SELECT id, name, parent_id, sort_order FROM latest",
        "lib_children": f"WITH {_LATEST} SELECT parent_id, count(*) AS children, min(name) AS first_name, max(name) AS last_name FROM latest WHERE parent_id IS NOT NULL GROUP BY parent_id",
        "lib_reroot": f"""WITH {_LATEST}, gone AS (SELECT id FROM latest WHERE lower(name) LIKE '%draft%')
SELECT id, CASE WHEN parent_id NOT IN (SELECT id FROM gone) THEN parent_id END AS parent_id FROM latest WHERE id NOT IN (SELECT id FROM gone)""",
    }
