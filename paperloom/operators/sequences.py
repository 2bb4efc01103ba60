"""Running values over ordered groups of any size.

A window over a group runs in one task; a group that holds a third of the rows must not. ``scan_groups`` sorts by range
partitioning, so a group spreads over tasks, sums up within blocks of bounded length, carries the blocks' totals over
in a second small step, and joins the two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.staging import spread_of, stage

#: Rows of a block.
BLOCK = 4096


def scan_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, tuple[str, Column]], block: int = BLOCK) -> DataFrame:
    """The rows with, for each name in ``values``, the running value over the rows before them in their group.

    Each value is (how, expression): ``sum``, ``max``, ``min``, or ``last`` (the last value that isn't null). A group's
    first row has null. ``order`` must be total within a group for a defined result. Null keys are a group.
    """
    spread = spread_of(df)
    named = df.select("*", *[e.alias(f"_v_{n}") for n, (_, e) in values.items()])
    sort = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    placed = stage(
        named.repartitionByRange(spread, *sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()).withColumn("_block", F.floor(F.col("_at") / block).cast("bigint"))
    )
    how = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c), "last": lambda c: F.last(c, ignorenulls=True)}
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = {n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))) if h == "last" else how[h](f"_v_{n}") for n, (h, _) in values.items()}
    blocks = placed.groupBy(*keys, "_block").agg(*[t.alias(f"_t_{n}") for n, t in totals.items()])
    # a group has one row a block here
    carried = blocks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), *[how[h](f"_t_{n}").over(over).alias(f"_c_{n}") for n, (h, _) in values.items()])
    near = placed.select("*", *[how[h](f"_v_{n}").over(inside).alias(f"_n_{n}") for n, (h, _) in values.items()])
    match = F.col("_block") == F.col("_b")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = near.join(carried, match)

    def both(n: str, h: str) -> Column:
        a, b = F.col(f"_n_{n}"), F.col(f"_c_{n}")
        if h == "sum":
            return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        return {"max": F.greatest(a, b), "min": F.least(a, b), "last": F.coalesce(a, b)}[h]

    return joined.select(*df.columns, *[both(n, h).alias(n) for n, (h, _) in values.items()])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "no", start: int = 1) -> DataFrame:
    """Rows numbered within their group, in order."""
    out = scan_groups(df, keys, order, {name: ("sum", F.lit(1))})
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)) + start)


def lag_values(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str]) -> DataFrame:
    """Rows with the previous row's value (null too) of each column in ``columns`` (new name -> column)."""
    out = scan_groups(df, keys, order, {n: ("last", F.struct(F.col(c).alias("x"))) for n, c in columns.items()})
    return out.select(*df.columns, *[F.col(f"{n}.x").alias(n) for n in columns])


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column], starts: Column, name: str = "island") -> DataFrame:
    """Rows with the number of their island: how many rows up to them begin one (``starts`` holds). Rows before the
    first that does are island 0. For islands from 1 let ``starts`` hold for the first row, too."""
    flag = F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    out = scan_groups(df, keys, order, {"_before": ("sum", flag)})
    return out.select(*df.columns, (F.coalesce("_before", F.lit(0)) + flag).cast("bigint").alias(name))
