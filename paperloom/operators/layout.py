"""Blocks of page layouts: reading them from JSON, grouping, nearest neighbours, spans, sections, checks.

A page and a document are bounded units (one JSON value each), so windows over them are safe.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as T

#: Schema of blocks_json.
BLOCKS = """array<struct<id string, page int, bbox struct<x double, y double, width double, height double>, role string, readingOrder int,
sectionPath array<string>, text string, latex string, confidence double, contentMode string>>"""
#: Schema of structure_json, as far as it is used.
STRUCTURE = """struct<pageCount int, sections array<struct<id string, kind string, heading string, level int, parentId string>>,
elements array<struct<id string, type string, page int, readingOrder int, label string, content string, blockIds array<string>>>>"""
#: Roles that aren't content.
FURNITURE = ["HEADER", "FOOTER", "MARGIN_METADATA"]


def layout_blocks(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, paper_id, pages, block_id, page, ord, role, mode, section, text, latex, confidence, x, y, w, h): one
    row a block. Damaged JSON gives no row; missing texts are empty."""
    sound = artifacts.filter(F.try_parse_json("blocks_json").isNotNull())
    b = sound.select(F.col("id").alias("artifact_id"), "paper_id", F.col("page_count").alias("pages"), F.explode(F.from_json("blocks_json", BLOCKS)).alias("b"))
    return b.select(
        "artifact_id", "paper_id", "pages", F.col("b.id").alias("block_id"), "b.page", F.col("b.readingOrder").alias("ord"), "b.role", F.col("b.contentMode").alias("mode"),
        F.array_join(F.coalesce("b.sectionPath", F.array().cast("array<string>")), " / ").alias("section"), F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.latex", F.lit("")).alias("latex"), "b.confidence",
        F.col("b.bbox.x").alias("x"), F.col("b.bbox.y").alias("y"), F.col("b.bbox.width").alias("w"), F.col("b.bbox.height").alias("h"),
    )


def structures(memories: DataFrame) -> DataFrame:
    """(memory_id, paper_id, s): the parsed structure of every memory whose JSON is sound."""
    return memories.filter(F.try_parse_json("structure_json").isNotNull()).select(F.col("id").alias("memory_id"), "paper_id", F.from_json("structure_json", STRUCTURE).alias("s"))


def every_page(blocks: DataFrame, artifacts: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(artifact_id, page, <values>): aggregates of each page from 1 to the page count, empty pages too."""
    pages = artifacts.filter("page_count > 0").select(F.col("id").alias("artifact_id"), F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    found = blocks.groupBy("artifact_id", "page").agg(*[v.alias(n) for n, v in values.items()])
    return pages.join(found, ["artifact_id", "page"], "left")


def nearest_above(items: DataFrame, others: DataFrame, most: float) -> DataFrame:
    """Each item with the nearest other block above it on its page that overlaps it sideways: (artifact_id, block_id,
    other_id, gap); items without one have nulls. Ties go to the other's id."""
    o = others.select("artifact_id", "page", F.col("block_id").alias("other_id"), *[F.col(c).alias(f"o_{c}") for c in "xywh"])
    gap = F.col("y") - (F.col("o_y") + F.col("o_h"))
    sideways = F.least(F.col("x") + F.col("w"), F.col("o_x") + F.col("o_w")) > F.greatest("x", "o_x")
    pairs = items.join(o, ["artifact_id", "page"]).filter(sideways & (gap >= -0.01) & (gap <= most))
    best = pairs.groupBy("artifact_id", "block_id").agg(F.min(F.struct(F.round(gap, 6).alias("gap"), "other_id")).alias("m"))
    return items.select("artifact_id", "block_id").join(best, ["artifact_id", "block_id"], "left").select("artifact_id", "block_id", "m.other_id", "m.gap")


def latest_before(blocks: DataFrame, is_owner: Column, is_item: Column, pages: int = 1) -> DataFrame:
    """(artifact_id, block_id, owner_id): each item with the last owner before it in reading order, at most ``pages``
    pages back."""
    w = Window.partitionBy("artifact_id").orderBy("ord", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = blocks.withColumn("_o", F.last(F.when(is_owner, F.struct("block_id", "page")), ignorenulls=True).over(w))
    near = F.col("page") - F.col("_o.page") <= pages
    return seen.filter(is_item).select("artifact_id", "block_id", F.when(near, F.col("_o.block_id")).alias("owner_id"))


def neighbours(blocks: DataFrame, is_item: Column, has_text: Column) -> DataFrame:
    """(artifact_id, block_id, before_id, after_id): each item with the nearest blocks with text around it."""
    order = Window.partitionBy("artifact_id").orderBy("ord", "block_id")
    named = F.when(has_text, F.col("block_id"))
    seen = blocks.withColumn("before_id", F.last(named, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "after_id", F.first(named, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    )
    return seen.filter(is_item).select("artifact_id", "block_id", "before_id", "after_id")


def overlapping(blocks: DataFrame, least: float) -> DataFrame:
    """(artifact_id, page, a_id, b_id, share): pairs of blocks of one page that overlap by ``least`` of the smaller."""
    cols = ["artifact_id", "page"]
    a = blocks.filter(G.valid(G.box())).select(*cols, F.col("block_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    b = blocks.filter(G.valid(G.box())).select(*cols, F.col("block_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    share = G.overlap(G.box("a_"), G.box("b_"))
    return a.join(b, cols).filter("a_id < b_id").withColumn("share", F.round(share, 6)).filter(F.col("share") >= least).select(*cols, "a_id", "b_id", "share")


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Body blocks merged to paragraphs: (artifact_id, paragraph, page, blocks, text). A block joins the one before it
    on the same page, lane and section unless that ends a sentence."""
    body = blocks.filter("role = 'BODY'").withColumn("lane", G.lane(F.col("page"), G.box()))
    w = Window.partitionBy("artifact_id").orderBy("ord", "block_id")
    joins = (F.lag("page").over(w) == F.col("page")) & (F.lag("lane").over(w) == F.col("lane")) & (F.lag("section").over(w) == F.col("section")) & ~T.ends_sentence(F.lag("text").over(w))
    flagged = body.withColumn("_start", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    numbered = flagged.withColumn("paragraph", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", "text"))), lambda r: r["text"])
    return numbered.groupBy("artifact_id", "paragraph").agg(F.min("page").alias("page"), F.count("*").alias("blocks"), T.joined_paragraph(lines).alias("text"))


def section_parents(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sections with the parent that their level gives: the last one before with a smaller level; pop while level >=.

    ``sections`` has keys, pos, section_id and level (1 to 9); null levels count as 1.
    """
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce("level", F.lit(1))
    seen = [F.max(F.when(level == n, F.struct("pos", "section_id"))).over(before) for n in range(1, 10)]
    out = sections
    for n, c in enumerate(seen, 1):
        out = out.withColumn(f"_l{n}", c)
    lower = [F.when(level > n, F.col(f"_l{n}")) for n in range(1, 9)]
    return out.withColumn("parent_id", F.greatest(*lower)["section_id"]).drop(*[f"_l{n}" for n in range(1, 10)])


def geometric_order(blocks: DataFrame) -> DataFrame:
    """Valid blocks with their place (from 1) in the order of reading that their boxes give, page after page."""
    boxed = blocks.filter(G.valid(G.box())).withColumn("lane", G.lane(F.col("page"), G.box()))
    down = Window.partitionBy("artifact_id", "page").orderBy("y", "x", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    region = F.sum(F.when(F.col("lane") == "FULL", 1).otherwise(0)).over(down)
    rank = F.when(F.col("lane") == "FULL", 0).when(F.col("lane") == "LEFT", 1).otherwise(2)
    order = Window.partitionBy("artifact_id").orderBy("page", "region", "rank", "y", "x", "block_id")
    return boxed.withColumn("region", region).withColumn("rank", rank).withColumn("place", F.row_number().over(order)).drop("rank")


#: Limits of a span.
SPAN_BLOCKS, SPAN_CHARACTERS = 12, 1600


def spans(blocks: DataFrame) -> DataFrame:
    """(artifact_id, span_id, role, page, blocks, characters, first_block, last_block): blocks merged to spans.

    A block joins the span before it if role, section and page are the same, the gap between them is small, they
    share a column, and the span stays within its limits; as the limits look at what is merged so far, each document
    is folded in order, one task a document.
    """

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, now, page, ordinal = [], None, None, 0
        for b in pdf.sort_values(["ord", "block_id"]).itertuples(index=False):
            joins = False
            if now and b.page == page:
                p = now["last"]
                gap = b.y - (p.y + p.h)
                wide = max(0.0, min(p.x + p.w, b.x + b.w) - max(p.x, b.x)) / max(0.001, min(p.w, b.w))
                joins = (
                    now["role"] == b.role and now["section"] == b.section and now["n"] < SPAN_BLOCKS and now["chars"] + len(b.text) <= SPAN_CHARACTERS
                    and -0.012 <= gap <= max(0.018, min(0.045, max(p.h, b.h) * 1.35)) and (wide >= 0.55 or abs(p.x - b.x) <= 0.06)
                )
            if joins:
                now["n"] += 1
                now["chars"] += len(b.text)
                now["last"] = b
            else:
                if now:
                    rows.append(now)
                ordinal = 0 if b.page != page else ordinal + 1
                page = b.page
                now = {"id": f"p{b.page}-s{ordinal:04d}", "role": b.role, "section": b.section, "page": b.page, "n": 1, "chars": len(b.text), "first": b.block_id, "last": b}
        rows += [now] if now else []
        return pd.DataFrame(
            [(key[0], r["id"], r["role"], r["page"], r["n"], r["chars"], r["first"], r["last"].block_id) for r in rows],
            columns=["artifact_id", "span_id", "role", "page", "blocks", "characters", "first_block", "last_block"],
        )

    kept = blocks.filter(~F.col("role").isin(FURNITURE) & (F.trim("text") != "") & G.valid(G.box()))
    cols = ["artifact_id", "block_id", "page", "ord", "role", "section", "text", "x", "y", "w", "h"]
    return kept.select(*cols).groupBy("artifact_id").applyInPandas(fold, "artifact_id bigint, span_id string, role string, page int, blocks int, characters int, first_block string, last_block string")


def structure_violations(parsed: DataFrame) -> DataFrame:
    """(memory_id, violation, n): what is wrong with a parsed structure."""
    e, s = F.col("s.elements"), F.col("s.sections")
    checks = {
        "element_without_id": F.size(F.filter(e, lambda x: F.coalesce(x["id"], F.lit("")) == "")),
        "element_repeated": F.size(F.transform(e, lambda x: x["id"])) - F.size(F.array_distinct(F.transform(e, lambda x: x["id"]))),
        "element_without_blocks": F.size(F.filter(e, lambda x: F.coalesce(F.size(x["blockIds"]), F.lit(0)) <= 0)),
        "element_page": F.size(F.filter(e, lambda x: (x["page"] < 1) | (x["page"] > F.col("s.pageCount")))),
        "element_blank": F.size(F.filter(e, lambda x: F.coalesce(F.trim(x["content"]), F.lit("")) == "")),
        "element_type": F.size(F.filter(e, lambda x: F.coalesce(F.trim(x["type"]), F.lit("")) == "")),
        "element_order": F.size(F.transform(e, lambda x: x["readingOrder"])) - F.size(F.array_distinct(F.transform(e, lambda x: x["readingOrder"]))),
        "section_without_id": F.size(F.filter(s, lambda x: F.coalesce(x["id"], F.lit("")) == "")),
        "section_repeated": F.size(F.transform(s, lambda x: x["id"])) - F.size(F.array_distinct(F.transform(s, lambda x: x["id"]))),
        "section_level": F.size(F.filter(s, lambda x: F.coalesce(x["level"], F.lit(0)) < 1)),
        "section_parent": F.size(F.filter(s, lambda x: (F.coalesce(x["parentId"], F.lit("")) != "") & ~F.exists(s, lambda y: y["id"] == x["parentId"]))),
    }
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("violation"), F.coalesce(c, F.lit(0)).cast("bigint").alias("n")) for n, c in checks.items()]), lambda x: x["n"] > 0)
    return parsed.select("memory_id", F.explode(found).alias("v")).select("memory_id", "v.violation", "v.n")
