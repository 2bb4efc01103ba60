"""Records checked and repaired: typed JSON with trimmed texts, known categories, bounded numbers and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema of a list of claims.
CLAIMS = "array<struct<category string, statement string, confidence double, evidenceBlockIds array<string>>>"
#: Categories of claims; any other becomes the last.
CATEGORIES = ["METHOD", "RESULT", "SCOPE", "OTHER"]


def parsed_claims(json_col: str, name: str) -> Column:
    """The claims of one list of a profile; null if the text is damaged or the list is no array."""
    return F.when(F.try_parse_json(json_col).isNotNull(), F.from_json(json_col, f"struct<{name} {CLAIMS}>")[name])


def repaired_claims(claims: Column, most: int | None = None) -> Column:
    """Claims with trimmed statements, blank and null ones dropped, categories in capitals and known, confidence within
    0 and 1 (0.5 where it is missing), evidence ids trimmed and distinct; at most ``most``, all by default."""
    kept = F.filter(claims, lambda c: c.isNotNull() & (F.trim(F.coalesce(c["statement"], F.lit(""))) != ""))

    def fix(c: Column) -> Column:
        category = F.upper(F.trim(F.coalesce(c["category"], F.lit(""))))
        ids = F.array_distinct(F.filter(F.transform(F.coalesce(c["evidenceBlockIds"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
        return F.struct(
            F.when(category.isin(CATEGORIES), category).otherwise(CATEGORIES[-1]).alias("category"), F.trim(c["statement"]).alias("statement"),
            F.least(F.greatest(F.coalesce(c["confidence"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), ids.alias("evidenceBlockIds"),
        )

    fixed = F.transform(kept, fix)
    return fixed if most is None else F.slice(fixed, 1, most)


def claim_issues(claims: Column, most: int = 100) -> Column:
    """What had to be repaired, as a list of names; more claims than ``most`` are an issue, too."""
    any_ = lambda test: F.exists(claims, test)
    return F.array_compact(
        F.array(
            F.when(claims.isNull(), "MISSING"),
            F.when(any_(lambda c: c.isNull() | (F.trim(F.coalesce(c["statement"], F.lit(""))) == "")), "BLANK_STATEMENT"),
            F.when(any_(lambda c: c.isNotNull() & ~F.coalesce(c["category"].isin(CATEGORIES), F.lit(False))), "CATEGORY"),
            F.when(any_(lambda c: c.isNotNull() & (c["confidence"].isNull() | (c["confidence"] < 0) | (c["confidence"] > 1))), "CONFIDENCE"),
            F.when(any_(lambda c: c.isNotNull() & (F.coalesce(F.size(c["evidenceBlockIds"]), F.lit(0)) <= 0)), "NO_EVIDENCE"),
            F.when(F.size(claims) > most, "TOO_MANY"),
        )
    )


def grounded(claims: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(claim_id, ids, known_ids): evidence ids of every claim and how many of them are known for its keys.

    ``claims`` has claim_id, the keys and ids (array); ``known`` the keys and block_id. A claim without ids counts 0."""
    links = claims.select("claim_id", *keys, F.explode_outer(F.array_distinct("ids")).alias("block_id"))
    hit = links.join(known.select(*keys, "block_id").distinct().withColumn("_k", F.lit(1)), [*keys, "block_id"], "left")
    return hit.groupBy("claim_id").agg(F.count("block_id").alias("ids"), F.count("_k").alias("known_ids"))
