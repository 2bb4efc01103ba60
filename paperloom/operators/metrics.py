"""Evaluation metrics and order statistics, each an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.sequences import scan_groups


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column a share): the value at floor((n - 1) * share) of the sorted values of a group, from 0; nulls
    don't count.

    Exact without sorting a group in one task: values are counted first, and the running count goes over distinct
    values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    run = scan_groups(counts, keys, [F.col(value).asc()], {"_before": ("sum", F.col("_c"))}).withColumn("_before", F.coalesce("_before", F.lit(0)))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = run.join(totals, list(keys))
    hit = {n: F.floor((F.col("_n") - 1) * F.lit(s)).cast("bigint") for n, s in shares.items()}
    picks = [F.max(F.when((F.col("_before") <= h) & (h < F.col("_before") + F.col("_c")), F.col(value))).alias(n) for n, h in hit.items()]
    return joined.groupBy(*keys).agg(*picks)


def precision_recall(cases: DataFrame, required: str, allowed: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over multi-label cases given as arrays.

    Required and predicted is a hit, required and not predicted a miss, predicted and not allowed an error; what is
    only allowed doesn't count. Ratios without a basis are null.
    """
    none = F.array().cast("array<string>")
    r, a, p = (F.array_distinct(F.coalesce(F.col(c), none)) for c in (required, allowed, predicted))
    marks = F.concat(
        F.transform(F.array_intersect(r, p), lambda x: F.struct(x.alias("label"), F.lit("tp").alias("m"))),
        F.transform(F.array_except(r, p), lambda x: F.struct(x.alias("label"), F.lit("fn").alias("m"))),
        F.transform(F.array_except(F.array_except(p, a), r), lambda x: F.struct(x.alias("label"), F.lit("fp").alias("m"))),
    )
    rows = cases.select(F.explode(marks).alias("x")).groupBy("x.label").agg(*[F.count_if(F.col("x.m") == m).alias(m) for m in ("tp", "fp", "fn")])
    return rows.select("label", "tp", "fp", "fn", *ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def ratios(tp: Column, fp: Column, fn: Column, digits: int = 6) -> list[Column]:
    """precision, recall and f1, rounded; null where nothing was found or wanted."""
    none = F.lit(None).cast("double")
    return [
        F.round(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(none), digits).alias("precision"),
        F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(none), digits).alias("recall"),
        F.round(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(none), digits).alias("f1"),
    ]


def ranking(hits: DataFrame, need: str, rank: str, relevant: str, k: int) -> DataFrame:
    """(needs, recall_at_k, mrr) of ranked results with a boolean ``relevant``: the share of needs with a relevant
    result among the first k, and the mean of 1 / rank of the first one (0 without one)."""
    first = hits.groupBy(need).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("_first"))
    return first.agg(
        F.count("*").alias("needs"), F.round(F.count_if(F.col("_first") <= k) / F.count("*"), 6).alias("recall_at_k"), F.round(F.sum(F.coalesce(1 / F.col("_first"), F.lit(0.0))) / F.count("*"), 6).alias("mrr")
    )


def term_groups(text: Column, groups: Column) -> Column:
    """Whether a text has at least one term of every group; no groups: true. Case is ignored."""
    low = F.lower(text)
    return F.forall(groups, lambda g: F.exists(g, lambda t: F.contains(low, F.lower(t))))


def share_of_best(df: DataFrame, value: str, name: str = "percent") -> DataFrame:
    """Rows with their value in percent of the greatest, rounded half up; for short lists."""
    return df.withColumn(name, F.floor(F.col(value) * 100 / F.greatest(F.lit(1), F.max(value).over(Window.partitionBy())) + 0.5).cast("bigint"))
