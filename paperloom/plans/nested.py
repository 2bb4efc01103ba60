"""Problem 4: records of tool calls and profiles as flat parent and child tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.nested import entries, linked, node_table, plain_name
from paperloom.session import table

#: Fixed values: (record kind, table, column, parent lists, child list, field that names a child object).
RECORDS = (
    ("arguments", "agent_tool_call", "arguments_json", ["needs"], "targets", None),
    ("result", "agent_tool_call", "result_json", ["needs"], "sources", "sourceId"),
    ("profile", "paper_memory", "profile_json", ["coreContributions", "keyFindings", "limitations", "benchmarkResults"], "evidenceBlockIds", None),
)


def record_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Parent and child nodes of all three kinds of records."""
    parts = [
        node_table(table(spark, folder, name), "id", column, [*lists, child], key).withColumn("record_kind", F.lit(kind))
        for kind, name, column, lists, child, key in RECORDS
    ]
    return reduce(DataFrame.unionByName, parts)


def _of(kinds: list[tuple]) -> F.Column:
    return reduce(lambda a, b: a | b, [(F.col("record_kind") == k) & (F.col("name") == plain_name(n)) for k, n in kinds])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each child, linked to its parent by containment of intervals."""
    nodes = record_nodes(spark, folder).filter(~F.col("kind").isin("array", "null"))
    is_parent = _of([(k, n) for k, _, _, lists, _, _ in RECORDS for n in lists]) & (F.col("kind") == "object")
    is_child = _of([(k, child) for k, _, _, _, child, _ in RECORDS])
    names = reduce(lambda c, n: c.when(F.col("parent_name") == plain_name(n), n), sorted({n for r in RECORDS for n in r[3]}), F)
    return (
        linked(nodes, is_parent, is_child, ["record_kind", "record_id", "row_no"])
        .select("record_kind", "record_id", names.alias("parent_list"), F.col("parent_list_pos").alias("parent_no"), F.col("list_pos").alias("child_no"), F.col("value").alias("child_key"))
        .distinct()
    )


def p4_parents(spark: SparkSession, folder: str) -> DataFrame:
    """(record_kind, record_id, parent_list, parent_no, pre, post): the parents with their interval labels."""
    nodes = record_nodes(spark, folder)
    names = {plain_name(n): n for r in RECORDS for n in r[3]}
    found = reduce(DataFrame.unionByName, [entries(nodes, n, F.col("kind") == "object").withColumn("parent_list", F.lit(n)) for n in names.values()])
    return found.select("record_kind", "record_id", "parent_list", F.col("list_pos").alias("parent_no"), "pre", "post").distinct()


def queries() -> dict:
    """The queries of this module."""
    return {"p4_found": p4_found, "p4_parents": p4_parents}


def oracle_sql() -> dict[str, str]:
    """None: fences, byte order marks and texts within texts are beyond SQL; tested by brute force."""
    return {}
