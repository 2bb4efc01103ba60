"""Queries over the event log and the task table: summaries, search, order statistics, sequences, leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import rows as R
from paperloom.operators.metrics import nearest_rank, precision_recall, ratios
from paperloom.operators.sequences import islands, lag_values, number_rows
from paperloom.session import table

#: Events that end badly.
BAD = ["error"]


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the number in their properties."""
    return table(spark, folder, "events").withColumn("tokens", F.from_json("props", "k bigint")["k"])


def eve_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per type since 10 January: events, mean value, tokens (0 without any)."""
    return events(spark, folder).filter("ts >= timestamp_ntz'2024-01-10 00:00:00'").groupBy("event_type").agg(
        F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
    )


def eve_overall(spark: SparkSession, folder: str) -> DataFrame:
    """The types folded to good and bad, their weighted mean from rounded parts, and the bad share."""
    parts = events(spark, folder).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    bad = F.col("event_type").isin(BAD)
    return parts.agg(
        F.sum("n").alias("events"),
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("bad"),
        F.round(F.sum(F.floor(F.col("mean") * F.col("n") + 0.5)) / F.sum("n"), 6).alias("mean_value"),
        F.round(F.sum(F.when(bad, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("bad_share"),
    )


def eve_search(spark: SparkSession, folder: str) -> DataFrame:
    """Third page of 40 of the purchases of users below 100 with a value over 5, newest first."""
    found = events(spark, folder).filter("event_type = 'purchase' and user_id < 100 and value > 5")
    return R.page(found, [F.col("ts").desc(), F.col("event_id").desc()], 3, 40).select("event_id", "user_id", "value")


def eve_days(spark: SparkSession, folder: str) -> DataFrame:
    """Events, users and values per day and type."""
    return events(spark, folder).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


def eve_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Users with their counts of every type, as columns."""
    kinds = ["signup", "view", "click", "purchase", "error"]
    return events(spark, folder).groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


def eve_retained(spark: SparkSession, folder: str) -> DataFrame:
    """Events that a retention of 15 days before the newest keeps, per type."""
    e = events(spark, folder)
    newest = e.agg(F.max("ts")).scalar()
    return R.keep_since(e, "ts", newest - F.expr("interval 15 days")).groupBy("event_type").agg(F.count("*").alias("kept"))


def eve_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 95th percentile of the values per type, by the lower nearest rank."""
    return nearest_rank(events(spark, folder), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def eve_sittings(spark: SparkSession, folder: str) -> DataFrame:
    """Per user and sitting (a gap over six hours starts one): events, kinds, first event."""
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    lagged = lag_values(events(spark, folder).select("user_id", "event_id", "ts", "event_type"), ["user_id"], order, {"before": "ts"})
    starts = F.col("before").isNull() | (F.timestamp_diff("SECOND", F.col("before"), F.col("ts")) > 21600)
    return islands(lagged, ["user_id"], order, starts, "sitting").groupBy("user_id", "sitting").agg(F.count("*").alias("events"), F.countDistinct("event_type").alias("kinds"), F.min("event_id").alias("first_event"))


def eve_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each type follows each other type of the same user."""
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    pairs = lag_values(events(spark, folder).select("user_id", "event_id", "ts", "event_type"), ["user_id"], order, {"before": "event_type"})
    return pairs.filter("before is not null").groupBy("before", F.col("event_type").alias("after")).agg(F.count("*").alias("times"))


def eve_cursor(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered events of every user, those after each user's twentieth."""
    e = number_rows(events(spark, folder).select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()], "no")
    return e.filter("no > 20").select("user_id", "no", "event_id")


def eve_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Per user: a prediction (over three errors in all) against the label (an error after the 20th)."""
    e = events(spark, folder)
    users = e.groupBy("user_id").agg(
        F.count_if((F.col("event_type") == "error") & (F.col("ts") < F.expr("timestamp_ntz'2024-01-20 00:00:00'"))).alias("early"),
        F.count_if((F.col("event_type") == "error") & (F.col("ts") >= F.expr("timestamp_ntz'2024-01-20 00:00:00'"))).alias("late"),
    )
    said, true = F.col("early") > 3, F.col("late") > 0
    sums = users.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    return sums.select("tp", "fp", "fn", *ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def eve_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Multi-label metrics: the types of a user's last ten days predicted by those of the first ten, signup allowed."""
    e = events(spark, folder)
    users = e.groupBy("user_id").agg(
        F.collect_set(F.when(F.col("ts") < F.expr("timestamp_ntz'2024-01-03 00:00:00'"), F.col("event_type"))).alias("predicted"),
        F.collect_set(F.when(F.col("ts") >= F.expr("timestamp_ntz'2024-01-28 00:00:00'"), F.col("event_type"))).alias("required"),
    )
    return precision_recall(users.withColumn("allowed", F.array(F.lit("signup"))), "required", "allowed", "predicted")


def tsk_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tasks: counts per status, recent and old failures apart, in one pass."""
    o = table(spark, folder, "orders")
    old = F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01 00:00:00'")
    s = F.col("o_orderstatus")
    return o.agg(
        F.count("*").alias("total"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("running"), F.count_if(s == "F").alias("closed"),
        F.count_if((s == "F") & old).alias("historical"), F.greatest(F.lit(0), F.count_if(s == "F") - F.count_if((s == "F") & old)).cast("bigint").alias("recent"),
    )


def tsk_next(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 open tasks to run next: due, oldest first, then key."""
    due = table(spark, folder, "orders").filter("o_orderstatus = 'O' and (o_orderdate is null or o_orderdate <= timestamp_ntz'1998-12-31 00:00:00')")
    return due.orderBy(F.col("o_orderdate").asc_nulls_first(), F.col("o_orderkey").asc()).limit(100).select("o_orderkey", "o_orderpriority")


def tsk_expired(spark: SparkSession, folder: str) -> DataFrame:
    """Running tasks whose lease of 30 days from their date had ended at mid 1995, per priority, with the backoff
    (30 s doubled per line item, at most 64 times) summed."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("attempts"))
    late = table(spark, folder, "orders").filter("o_orderstatus = 'P' and o_orderdate + interval 30 days < timestamp_ntz'1995-07-01 00:00:00'")
    backoff = (F.lit(30) * F.pow(F.lit(2.0), F.least(F.col("attempts") - 1, F.lit(6)))).cast("bigint")
    return late.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("tasks"), F.sum(backoff).alias("backoff_seconds"))


def tsk_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks per nation and segment with their lines: a three-way join on keys."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("q"), 2).alias("quantity"))


def tsk_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and value per region: joins down the tree of regions, nations and customers."""
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.sum("n").alias("orders"), F.round(F.sum("v"), 1).alias("total"))


def queries() -> dict:
    """The queries of this module."""
    return {n: f for n, f in globals().items() if n.startswith(("eve_", "tsk_"))}


_E = "e AS (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS tokens FROM events)"


def oracle_sql() -> dict[str, str]:
    """DuckDB texts with the same results."""
    ratio = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""
    order = "PARTITION BY user_id ORDER BY ts, event_id"
    return {
        "eve_summary": f"WITH {_E} SELECT event_type, count(*) AS events, round(avg(value), 6) AS mean_value, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM e WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type",
        "eve_overall": """WITH p AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS events, CAST(sum(CASE WHEN event_type = 'error' THEN n ELSE 0 END) AS BIGINT) AS bad, round(sum(floor(mean * n + 0.5)) / sum(n), 6) AS mean_value,
round(sum(CASE WHEN event_type = 'error' THEN n ELSE 0 END) / sum(n), 6) AS bad_share FROM p""",
        "eve_search": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND user_id < 100 AND value > 5 ORDER BY ts DESC, event_id DESC LIMIT 40 OFFSET 80",
        "eve_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "eve_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("signup", "view", "click", "purchase", "error")) + " FROM events GROUP BY user_id",
        "eve_retained": "SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 15 DAY FROM events) GROUP BY 1",
        "eve_ranks": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (i = floor((n - 1) * 0.5)) AS p50, max(value) FILTER (i = floor((n - 1) * 0.95)) AS p95 FROM r GROUP BY event_type""",
        "eve_sittings": f"""WITH l AS (SELECT *, lag(ts) OVER ({order}) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR (epoch_us(ts) - epoch_us(before)) // 1000000 > 21600 THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS sitting FROM l)
SELECT user_id, CAST(sitting AS BIGINT) AS sitting, count(*) AS events, count(DISTINCT event_type) AS kinds, min(event_id) AS first_event FROM s GROUP BY ALL""",
        "eve_transitions": f"SELECT before, event_type AS after, count(*) AS times FROM (SELECT *, lag(event_type) OVER ({order}) AS before FROM events) WHERE before IS NOT NULL GROUP BY ALL",
        "eve_cursor": f"SELECT user_id, no, event_id FROM (SELECT *, row_number() OVER ({order}) AS no FROM events) WHERE no > 20",
        "eve_failures": f"""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND ts < TIMESTAMP '2024-01-20') AS early, count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-20') AS late FROM events GROUP BY 1),
s AS (SELECT count(*) FILTER (early > 3 AND late > 0) AS tp, count(*) FILTER (early > 3 AND late = 0) AS fp, count(*) FILTER (early <= 3 AND late > 0) AS fn FROM u)
SELECT tp, fp, fn, {ratio} FROM s""",
        "eve_labels": f"""WITH g AS (SELECT user_id, event_type AS label, bool_or(ts < TIMESTAMP '2024-01-03') AS p, bool_or(ts >= TIMESTAMP '2024-01-28') AS r FROM events GROUP BY ALL),
s AS (SELECT label, count(*) FILTER (r AND p) AS tp, count(*) FILTER (p AND NOT r AND label <> 'signup') AS fp, count(*) FILTER (r AND NOT p) AS fn FROM g GROUP BY label)
SELECT label, tp, fp, fn, {ratio} FROM s WHERE tp + fp + fn > 0""",
        "tsk_counts": """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS closed,
count(*) FILTER (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01') AS historical, count(*) FILTER (o_orderstatus = 'F' AND NOT o_orderdate < TIMESTAMP '1996-01-01') AS recent FROM orders""",
        "tsk_next": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-12-31' ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 100",
        "tsk_expired": """SELECT o_orderpriority, count(*) AS tasks, CAST(sum(30 * pow(2, least(attempts - 1, 6))) AS BIGINT) AS backoff_seconds
FROM orders JOIN (SELECT l_orderkey, count(*) AS attempts FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1995-07-01' GROUP BY 1""",
        "tsk_customers": """SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(q), 2) AS quantity FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
        "tsk_regions": """SELECT r_name, count(*) AS orders, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    }
