"""Problem 1: the folder tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.hierarchy import contained, hierarchy, latest_rows, unsound
from paperloom.session import table
from paperloom.staging import stage


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Folders that hang on no sound root."""
    rows = latest_rows(table(spark, folder, "folder"), "id", "updated_at", ["parent_id"])
    return unsound(rows).select(F.col("id").alias("folder_id"), "anchor_id", "reason")


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Path, depth, root and nested-set range of every sound folder."""
    return hierarchy(table(spark, folder, "folder"))


def p1_below(spark: SparkSession, folder: str) -> DataFrame:
    """(folder_id, below_id, steps): every folder with every folder below it, by range containment."""
    tree = stage(hierarchy(table(spark, folder, "folder"), paths=False).select("id", "depth", "lft", "rgt"))
    bits = max(1, tree.count().bit_length())
    outer = tree.select(F.col("id").alias("folder_id"), F.col("depth").alias("d"), "lft", "rgt")
    inner = tree.select(F.col("id").alias("below_id"), F.col("depth").alias("e"), F.col("lft").alias("at"))
    return contained(outer, inner, bits).select("folder_id", "below_id", (F.col("e") - F.col("d")).alias("steps"))


def queries() -> dict:
    """The queries of this module."""
    return {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_below": p1_below}


#: Rows that count; DuckDB's recursive queries then follow the parents.
_LATEST = """latest AS (SELECT id, parent_id, name, sort_order FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, parent_id DESC NULLS LAST, name DESC NULLS LAST, sort_order DESC NULLS LAST) AS rn
  FROM folder WHERE id IS NOT NULL) WHERE rn = 1)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB texts for the same results; p1_hierarchy has arrays and a preorder and is tested by brute force."""
    return {
        "p1_found": f"""WITH RECURSIVE {_LATEST},
reach AS (SELECT id, parent_id AS far, 1 AS steps FROM latest WHERE parent_id IS NOT NULL
  UNION SELECT r.id, l.parent_id, 1 FROM reach r JOIN latest l ON r.far = l.id WHERE l.parent_id IS NOT NULL),
ring AS (SELECT id, min(far) AS least FROM reach WHERE id IN (SELECT id FROM reach WHERE id = far) GROUP BY id),
lost AS (SELECT l.id FROM latest l WHERE l.parent_id IS NOT NULL AND l.parent_id NOT IN (SELECT id FROM latest))
SELECT id AS folder_id, least AS anchor_id, 'cycle' AS reason FROM ring
UNION ALL SELECT DISTINCT r.id, g.least, 'below_cycle' FROM reach r JOIN ring g ON r.far = g.id WHERE r.id NOT IN (SELECT id FROM ring)
UNION ALL SELECT id, id, 'orphan' FROM lost
UNION ALL SELECT DISTINCT r.id, r.far, 'below_orphan' FROM reach r JOIN lost o ON r.far = o.id WHERE r.id NOT IN (SELECT id FROM lost)""",
        "p1_below": f"""WITH RECURSIVE {_LATEST},
down AS (SELECT id, id AS root FROM latest WHERE parent_id IS NULL UNION SELECT l.id, d.root FROM latest l JOIN down d ON l.parent_id = d.id),
pairs AS (SELECT l.parent_id AS folder_id, l.id AS below_id, 1 AS steps FROM latest l JOIN down d ON l.id = d.id WHERE l.parent_id IS NOT NULL
  UNION ALL SELECT l.parent_id, p.below_id, p.steps + 1 FROM pairs p JOIN latest l ON p.folder_id = l.id WHERE l.parent_id IS NOT NULL)
SELECT folder_id, below_id, steps FROM pairs""",
    }
