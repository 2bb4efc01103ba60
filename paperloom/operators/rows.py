"""Row-set operators: latest rows, snapshots and links, paging, top-k, distinct with order, columns kept on update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the one greatest by ``order`` (nulls first), then by all other columns. An aggregate with
    map-side combine, so a hot key is reduced before the shuffle. Null keys are one key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank from 1; Spark cuts to k before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, both brought into range; ``order`` must end with a unique column."""
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def after_key(df: DataFrame, column: str, id_col: str, last: tuple | None, size: int) -> DataFrame:
    """Keyset page: the ``size`` rows after ``last`` = (value, id) in descending order of column and id."""
    if last is not None:
        value, own = F.lit(last[0]), F.lit(last[1])
        df = df.filter((F.col(column) < value) | ((F.col(column) == value) & (F.col(id_col) < own)))
    return df.orderBy(F.col(column).desc(), F.col(id_col).desc()).limit(size)


def insert_ignore(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base with the new rows whose key it doesn't have; of equal keys among the new the least row."""
    rest = [c for c in new.columns if c not in keys]
    own = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in new.columns])
    return base.unionByName(own.join(base.select(*keys).distinct(), list(keys), "left_anti"))


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key of base and new, the latest by ``order``."""
    return latest_per_key(base.unionByName(new), keys, order)


def compare_and_set(base: DataFrame, changes: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """Base with the columns of those changes whose version matches; a change that applies raises the version by one.
    ``changes`` has at most one row a key."""
    new = changes.select(F.col(key), F.col(version).alias("_v"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    hit = F.col("_v").isNotNull() & (F.col("_v") == F.col(version))
    joined = base.join(new, key, "left")
    values = {c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in columns}
    values[version] = F.when(hit, F.col(version) + 1).otherwise(F.col(version))
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in base.columns])


def replace_links(old: DataFrame, wanted: DataFrame, owner: str, items: str, item: str, position: str = "position") -> DataFrame:
    """Links of the owners in ``wanted`` (an array a row) replaced by their arrays, first of equal items kept; links of
    other owners stay."""
    new = wanted.select(owner, F.posexplode(F.array_distinct(items)).alias(position, item))
    kept = old.join(wanted.select(owner).distinct(), owner, "left_anti").select(owner, position, item)
    return kept.unionByName(new)


def keep_since(df: DataFrame, column: str, since: Column) -> DataFrame:
    """Retention: rows not older than ``since``; rows without a time stay."""
    return df.filter(F.col(column).isNull() | (F.col(column) >= since))


def keep_managed(old: DataFrame, new: DataFrame, key: str, managed: Sequence[str]) -> DataFrame:
    """New rows with the managed columns taken from the old row of the same key, where there is one."""
    kept = old.select(key, F.lit(True).alias("_had"), *[F.col(c).alias(f"_o_{c}") for c in managed])
    joined = new.join(kept, key, "left")
    return joined.select(*[F.when(F.col("_had"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in managed else F.col(c) for c in new.columns])


def backfill(df: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null values filled from the row of the same key in ``source`` (unique keys)."""
    other = source.select(key, *[F.col(c).alias(f"_s_{c}") for c in columns])
    joined = df.join(other, key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def first_text(*columns: str) -> Column:
    """The first of the columns that isn't null or blank, trimmed."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def violations(df: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """(id, violation): one row for every check that a row fails (its condition is true)."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return df.select(id_col, F.explode(found).alias("violation"))


def full_comparison(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(missing, extra, both): keys only expected, only found, and in both."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(1))
    b = actual.select(key).distinct().withColumn("_a", F.lit(1))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"), F.count_if(F.col("_a").isNotNull() & F.col("_e").isNotNull()).alias("both")
    )
