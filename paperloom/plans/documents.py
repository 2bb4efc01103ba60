"""Queries over layouts and structures of documents: pages, roles, order, captions, spans, versions, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as T
from paperloom.operators import grounding as N
from paperloom.operators import layout as L
from paperloom.operators import reading as D
from paperloom.operators import rows as R
from paperloom.operators import units as U
from paperloom.operators import validation as V
from paperloom.session import table


def has_text() -> Column:
    """Whether a block has text."""
    return F.length(F.trim("text")) > 0


def narrative() -> Column:
    """Whether a block is of the running text."""
    return F.col("role").isin("BODY", "ABSTRACT")


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Layout artifacts."""
    return table(spark, folder, "paper_layout_artifact")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all artifacts."""
    return L.layout_blocks(artifacts(spark, folder))


def doc_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Lane, area and validity of every block."""
    return blocks(spark, folder).select("artifact_id", "block_id", G.lane(F.col("page"), G.box()).alias("lane"), F.round(G.area(G.box()), 8).alias("area"), G.valid(G.box()).alias("valid"), G.region_size(G.box()).alias("region"))


def doc_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks and characters per artifact and role."""
    return blocks(spark, folder).groupBy("artifact_id", "role").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).cast("bigint").alias("characters"))


def doc_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page of every artifact, empty ones too: blocks, first and last in order, headings."""
    values = {"blocks": F.count("*"), "first_ord": F.min("ord"), "last_ord": F.max("ord"), "headings": F.count_if(F.col("role") == "HEADING")}
    out = L.every_page(blocks(spark, folder), artifacts(spark, folder).select("id", "page_count"), values)
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("blocks", "headings")})


def doc_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence, regions without text and blank blocks per artifact, with the list of what is wrong."""
    q = blocks(spark, folder).groupBy("artifact_id").agg(
        F.count("*").alias("blocks"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.col("confidence") < 0.5).alias("doubtful"),
        F.count_if(F.col("mode") == "REGION").alias("regions"), F.count_if(~has_text()).alias("blank"),
    )
    issues = F.array_join(F.array_compact(F.array(F.when(F.col("confidence") < 0.62, "LOW_CONFIDENCE"), F.when(F.col("regions") * 2 > F.col("blocks"), "MOSTLY_REGIONS"), F.when(F.col("blank") > 0, "BLANK_BLOCKS"))), ",")
    return q.withColumn("issues", issues)


def doc_score(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted score of every artifact with blocks: layout confidence, text density, geometry, clean text, block
    confidence, order; less for damaged text, at most 0.15 without text; whether to fall back."""
    a = artifacts(spark, folder).select(F.col("id").alias("artifact_id"), "layout_confidence", F.greatest("page_count", F.lit(1)).alias("n_pages"))
    bad = F.length("text") - F.length(F.regexp_replace("text", r"[\x{FFFD}\x{00}-\x{08}\x{0E}-\x{1B}]", ""))
    w = Window.partitionBy("artifact_id").orderBy("ord", "block_id")
    b = blocks(spark, folder).withColumn("no", F.row_number().over(w) - 1)
    s = b.groupBy("artifact_id").agg(
        F.sum(F.length("text")).cast("bigint").alias("characters"), F.avg(G.valid(G.box()).cast("double")).alias("geometry"), F.avg("confidence").alias("confidence"),
        (1 - F.sum(bad) / F.nullif(F.sum(F.length("text")), F.lit(0))).alias("clean"), F.avg((F.col("ord") == F.col("no")).cast("double")).alias("order"),
    )
    joined = s.join(a, "artifact_id")
    raw = (
        0.28 * F.col("layout_confidence") + 0.24 * T.clamp(F.col("characters") / F.col("n_pages") / 650.0) + 0.16 * F.col("geometry")
        + 0.14 * F.coalesce("clean", F.lit(0.0)) + 0.12 * F.col("confidence") + 0.06 * F.col("order")
    )
    damaged = F.coalesce("clean", F.lit(0.0)) < 0.94
    score = T.clamp(F.when(F.col("characters") == 0, F.least(raw, F.lit(0.15))).otherwise(raw) - F.when(damaged, 0.08).otherwise(0.0))
    return joined.select("artifact_id", "characters", F.round(score, 5).alias("score"), ((F.round(score, 5) < 0.68) | damaged | (F.col("characters") == 0)).alias("fallback"))


def doc_order(spark: SparkSession, folder: str) -> DataFrame:
    """Steps back up the page within a lane, per artifact, and the worst page's share of them."""
    b = blocks(spark, folder).filter(G.valid(G.box()) & ~F.col("role").isin(L.FURNITURE)).withColumn("lane", G.lane(F.col("page"), G.box()))
    w = Window.partitionBy("artifact_id", "page", "lane").orderBy("ord", "block_id")
    steps = b.withColumn("up", F.lag("y").over(w) > F.col("y") + 0.005)
    pages = steps.groupBy("artifact_id", "page").agg(F.count("up").alias("steps"), F.count_if("up").alias("ups"))
    return pages.groupBy("artifact_id").agg(F.sum("ups").alias("ups"), F.round(F.max(F.coalesce(F.col("ups") / F.nullif(F.col("steps"), F.lit(0)), F.lit(0.0))), 6).alias("worst"))


def doc_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Exact median height and width of the blocks per artifact and role."""
    return blocks(spark, folder).groupBy("artifact_id", "role").agg(F.round(F.median("h"), 6).alias("height"), F.round(F.median("w"), 6).alias("width"))


def doc_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The box around all valid blocks of each page and lane."""
    b = blocks(spark, folder).filter(G.valid(G.box()))
    return b.groupBy("artifact_id", "page", G.lane(F.col("page"), G.box()).alias("lane")).agg(
        F.round(F.min("x"), 6).alias("x0"), F.round(F.min("y"), 6).alias("y0"), F.round(F.max(F.col("x") + F.col("w")), 6).alias("x1"), F.round(F.max(F.col("y") + F.col("h")), 6).alias("y1")
    )


def doc_furniture(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that return on two or more pages of an artifact, numbers and case aside."""
    b = blocks(spark, folder).withColumn("print", T.fingerprint(F.col("text"))).filter("print != ''")
    return b.groupBy("artifact_id", "print").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("blocks")).filter("pages >= 2").select("artifact_id", F.sha2("print", 256).alias("print"), "pages", "blocks")


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """How many blocks of each role look like headings, like formulas, or end a sentence."""
    t = F.col("text")
    return blocks(spark, folder).groupBy("role").agg(
        F.count("*").alias("blocks"), F.count_if(T.is_heading(t)).alias("headings"), F.count_if(T.is_formula(t)).alias("formulas"), F.count_if(T.ends_sentence(t)).alias("sentences")
    )


def doc_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Every narrative block with the heading it stands under: forward fill in reading order."""
    w = Window.partitionBy("artifact_id").orderBy("ord", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks(spark, folder).withColumn("heading_id", F.last(F.when(F.col("role") == "HEADING", F.col("block_id")), ignorenulls=True).over(w))
    return b.filter(narrative()).select("artifact_id", "block_id", "heading_id")


def doc_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs: blocks merged and characters."""
    return L.paragraphs(blocks(spark, folder)).select("artifact_id", "paragraph", "page", "blocks", F.length("text").cast("bigint").alias("characters"))


def doc_captions(spark: SparkSession, folder: str) -> DataFrame:
    """Each caption with the nearest table or formula above it."""
    b = blocks(spark, folder)
    return L.nearest_above(b.filter("role = 'CAPTION'"), b.filter("role in ('TABLE', 'FORMULA', 'FIGURE')"), 0.3)


def doc_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Each formula with the last heading before it, at most one page back."""
    return L.latest_before(blocks(spark, folder), F.col("role") == "HEADING", F.col("role") == "FORMULA")


def doc_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Each table with the nearest narrative blocks around it."""
    return L.neighbours(blocks(spark, folder), F.col("role") == "TABLE", narrative() & has_text())


def doc_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of blocks of one page that overlap by 0.55 of the smaller."""
    return L.overlapping(blocks(spark, folder), 0.55)


def doc_best_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Each block's best overlapping partner, the smaller id on ties."""
    p = L.overlapping(blocks(spark, folder), 0.55)
    both = p.select("artifact_id", F.col("a_id").alias("block_id"), F.col("b_id").alias("other_id"), "share").unionByName(p.select("artifact_id", F.col("b_id").alias("block_id"), F.col("a_id").alias("other_id"), "share"))
    return both.groupBy("artifact_id", "block_id").agg(F.min(F.struct((-F.col("share")).alias("s"), "other_id")).alias("m")).select("artifact_id", "block_id", "m.other_id", (-F.col("m.s")).alias("share"))


def doc_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that a selection on page 1 (a box and a phrase) means: 0.78 of the covered share and 0.22 of the phrase's,
    of those at least 0.28 and 0.52 of the best in their artifact."""
    sel = tuple(F.lit(v) for v in (0.1, 0.2, 0.5, 0.4))
    phrase = "the citation window drifts over time"
    q = F.lit(phrase)
    b = blocks(spark, folder).filter("page = 1")
    score = 0.78 * G.coverage(sel, G.box()) + 0.22 * T.query_coverage(q, T.tokens(q), F.col("text"), T.tokens(F.col("text")))
    scored = b.select("artifact_id", "block_id", F.round(score, 6).alias("score"))
    best = scored.withColumn("best", F.max("score").over(Window.partitionBy("artifact_id")))
    return best.filter((F.col("score") >= 0.28) & (F.col("score") >= 0.52 * F.col("best"))).select("artifact_id", "block_id", "score")


def doc_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Every block with the class of blocks of the same text in its paper (case and white space aside): the class is a
    hash, the one kept is the most confident, then the longest, then the least id."""
    b = blocks(spark, folder).filter(has_text())
    key = F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", F.col("paper_id").cast("string"), T.collapsed(F.lower("text"))), 256), 1, 24))
    keyed = b.select(key.alias("key"), "artifact_id", "block_id", "confidence", F.length("text").alias("n"))
    classes = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("l"), "artifact_id", "block_id")).alias("kept"))
    return keyed.join(classes, "key").select("artifact_id", "block_id", "key", "copies", ((F.col("artifact_id") == F.col("kept.artifact_id")) & (F.col("block_id") == F.col("kept.block_id"))).alias("kept"))


def doc_references(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and numbered formulas that the texts of each paper mention, with the blocks that do."""
    b = blocks(spark, folder)
    t = F.col("text")
    kinds = F.concat(F.transform(T.numbers_in(t, T.FIGURES), lambda n: F.struct(F.lit("FIGURE").alias("kind"), n.alias("number"))), F.transform(T.numbers_in(t, T.FORMULAS), lambda n: F.struct(F.lit("FORMULA").alias("kind"), n.alias("number"))))
    return b.select("paper_id", "artifact_id", "block_id", F.explode(kinds).alias("k")).groupBy("paper_id", "k.kind", "k.number").agg(F.count("*").alias("blocks"), F.countDistinct("artifact_id").alias("artifacts"))


def doc_families(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered formulas grouped by number without letter: first and last label, members."""
    b = blocks(spark, folder)
    labels = b.select("artifact_id", F.explode(T.numbers_in(F.concat_ws(" ", "text", "latex"), T.LABELS)).alias("label")).distinct()
    return labels.groupBy("artifact_id", F.regexp_extract("label", r"^(\d+)", 1).alias("base")).agg(F.count("*").alias("members"), F.min("label").alias("first_label"), F.max("label").alias("last_label"))


def doc_reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every valid block by geometry: blocks over the whole width part a page into regions; within one
    the left lane is read before the right, each from the top."""
    return L.geometric_order(blocks(spark, folder)).select("artifact_id", "block_id", "place")


def doc_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of all artifacts."""
    return L.spans(blocks(spark, folder))


def doc_render(spark: SparkSession, folder: str) -> DataFrame:
    """Each artifact's text with a marker before every content block, as length and hash."""
    line = F.concat(F.lit("["), "block_id", F.lit(", "), F.col("page").cast("string"), F.lit(", "), "role", F.lit("] "), "text")
    b = blocks(spark, folder).filter(~F.col("role").isin(["FOOTER", *L.FURNITURE]) & has_text())
    lines = b.groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
    return lines.select("artifact_id", F.length("t").cast("bigint").alias("characters"), F.sha2("t", 256).alias("hash"))


def doc_mode(spark: SparkSession, folder: str) -> DataFrame:
    """How each artifact would be read: as it is, by regions, or in parts, by its size; and the visual parts that fit."""
    s = blocks(spark, folder).groupBy("artifact_id").agg(F.sum(F.length("text")).cast("bigint").alias("characters"), F.count_if(F.col("mode") == "REGION").alias("regions"), F.count("*").alias("n"))
    mode = F.when(F.col("regions") * 2 > F.col("n"), "VISUAL").when(F.col("characters") <= 4000, "WHOLE").otherwise("PARTS")
    return s.select("artifact_id", "characters", mode.alias("mode"), F.greatest(F.lit(0), F.least(F.lit(60), F.floor((90000 - F.col("characters") / 4) / 1024))).cast("bigint").alias("visual_parts"))


def doc_uncertain(spark: SparkSession, folder: str) -> DataFrame:
    """Regions to look at again per page: doubtful blocks and lane changes back within the same band."""
    b = blocks(spark, folder).filter(G.valid(G.box())).withColumn("lane", G.lane(F.col("page"), G.box()))
    w = Window.partitionBy("artifact_id", "page").orderBy("ord", "block_id")
    back = (F.lag("lane").over(w) == "RIGHT") & (F.col("lane") == "LEFT") & (F.col("y") <= F.lag("y").over(w) + F.lag("h").over(w) + 0.005)
    marked = b.withColumn("back", F.coalesce(back, F.lit(False)))
    return marked.groupBy("artifact_id", "page").agg(F.count_if(F.col("confidence") < 0.45).alias("doubtful"), F.count_if("back").alias("backward")).filter("doubtful > 0 or backward > 0")


def doc_continuations(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from the last narrative block of a page to the first of the next, if the former ends no sentence: sure if
    the latter begins in lower case."""
    b = blocks(spark, folder).filter(narrative() & has_text())
    w = Window.partitionBy("artifact_id").orderBy("ord", "block_id")
    pairs = b.withColumn("p", F.lag(F.struct("block_id", "page", "text")).over(w)).filter("page = p.page + 1").filter(~T.ends_sentence(F.col("p.text")))
    return pairs.select("artifact_id", F.col("p.block_id").alias("from_id"), F.col("block_id").alias("to_id"), F.when(F.col("text").rlike(r"^\s*\p{Ll}"), 0.92).otherwise(0.76).alias("confidence"))


def doc_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of consecutive pages that have tables: gaps and islands."""
    pages = blocks(spark, folder).filter("role = 'TABLE'").select("artifact_id", "page").distinct()
    w = Window.partitionBy("artifact_id").orderBy("page")
    return pages.withColumn("run", F.col("page") - F.row_number().over(w)).groupBy("artifact_id", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages")).drop("run")


def doc_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks and clean characters per language hint."""
    return blocks(spark, folder).groupBy(T.language(F.col("text")).alias("language")).agg(F.count("*").alias("blocks"), F.round(F.avg(T.clean_ratio(F.col("text"))), 6).alias("clean"))


def doc_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The newest sound artifact of every paper."""
    a = artifacts(spark, folder).filter("status = 'READY'").select("paper_id", "id", "document_hash", "parser_version", "layout_confidence")
    return R.latest_per_key(a, ["paper_id"], ["id"])


def doc_store(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts after storing all rows by (paper, hash, parser): the newest id of each with how often it was stored."""
    a = artifacts(spark, folder)
    return a.groupBy("paper_id", "document_hash", "parser_version").agg(F.max("id").alias("id"), F.count("*").alias("stored"), F.max_by("status", "id").alias("status"))


def doc_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Memories whose document version has a layout, and those that are stale."""
    a = artifacts(spark, folder).select("paper_id", "document_hash", F.col("parser_version").alias("layout_parser_version")).distinct()
    m = table(spark, folder, "paper_memory").select("id", "paper_id", "document_hash", "layout_parser_version", "status")
    hit = m.join(a.withColumn("bound", F.lit(True)), ["paper_id", "document_hash", "layout_parser_version"], "left")
    return hit.groupBy("status").agg(F.count("*").alias("memories"), F.count("bound").alias("bound"), F.count_if(F.col("bound").isNull()).alias("stale"))


def doc_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of the structures with the parent that the order of their levels gives."""
    s = L.structures(table(spark, folder, "paper_memory")).select("memory_id", F.posexplode("s.sections").alias("pos", "x"))
    flat = s.select("memory_id", "pos", F.col("x.id").alias("section_id"), "x.level")
    return L.section_parents(flat, ["memory_id"]).select("memory_id", "section_id", "parent_id")


def doc_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements per memory and type: how many, characters, first page."""
    e = L.structures(table(spark, folder, "paper_memory")).select("memory_id", F.explode("s.elements").alias("e"))
    return e.groupBy("memory_id", "e.type").agg(F.count("*").alias("elements"), F.sum(F.length("e.content")).cast("bigint").alias("characters"), F.min("e.page").alias("first_page"))


def doc_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The contents of each memory in reading order, none twice, cut at 12 000 characters: length and hash."""
    e = L.structures(table(spark, folder, "paper_memory")).select("memory_id", F.posexplode("s.elements").alias("pos", "e"))
    own = e.filter(F.trim("e.content") != "").groupBy("memory_id", F.col("e.content").alias("content")).agg(F.min("pos").alias("pos"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    return own.groupBy("memory_id").agg(F.substring(text, 1, 12000).alias("t")).select("memory_id", F.length("t").cast("bigint").alias("characters"), F.sha2("t", 256).alias("hash"))


def doc_block_members(spark: SparkSession, folder: str) -> DataFrame:
    """Elements whose block ids meet those of an artifact of the same paper: explode and equi-join."""
    e = L.structures(table(spark, folder, "paper_memory")).select("memory_id", "paper_id", F.explode("s.elements").alias("e")).select("memory_id", "paper_id", F.col("e.id").alias("element_id"), F.explode(F.array_distinct("e.blockIds")).alias("block_id"))
    b = blocks(spark, folder).select("paper_id", "block_id").distinct()
    return e.join(b.withColumn("known", F.lit(1)), ["paper_id", "block_id"], "left").groupBy("memory_id").agg(F.count("*").alias("links"), F.count("known").alias("known"), F.countDistinct("element_id").alias("elements"))


def doc_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each structure."""
    return L.structure_violations(L.structures(table(spark, folder, "paper_memory")))


def doc_read_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Roles and sections of all blocks, told by their lines and what came before."""
    return D.read_roles(blocks(spark, folder))


def doc_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Captions and the lines that continue them, with their figure numbers."""
    return D.caption_lines(blocks(spark, folder))


def doc_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Formula regions grown over neighbouring blocks."""
    return U.each_document(blocks(spark, folder).filter(G.valid(G.box())), U.formula_regions, "region_id string, page int, labels string, blocks int")


def doc_equations(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered equations: where each is displayed and how often it is named."""
    return U.each_document(blocks(spark, folder).filter(G.valid(G.box())), U.equations, "label string, definition_id string, page int, mentions int")


def doc_algorithms(spark: SparkSession, folder: str) -> DataFrame:
    """Algorithms with their blocks."""
    return U.each_document(blocks(spark, folder).filter(G.valid(G.box())), U.algorithms, "unit string, page int, blocks int, last_block string")


def doc_doubtful_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Doubtful blocks merged to regions."""
    return U.each_document(blocks(spark, folder).filter(G.valid(G.box())), U.doubtful_regions, "region_id string, page int, blocks int")


def doc_math(spark: SparkSession, folder: str) -> DataFrame:
    """How mathematical each block is."""
    return D.math_profile(blocks(spark, folder), "text", ["artifact_id", "block_id"])


def doc_physical(spark: SparkSession, folder: str) -> DataFrame:
    """Each block with the block that stands for its place."""
    return N.drop_copies(blocks(spark, folder).filter(G.valid(G.box())))


def doc_evidence_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Stable ids of all blocks as evidence, from paper, role and place."""
    b = blocks(spark, folder)
    return b.select("artifact_id", "block_id", N.evidence_key(F.col("paper_id").cast("string"), F.col("role"), N.place_text(F.col("page"), *G.box())).alias("evidence_key"))


def doc_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """All sources of every artifact in one table: spans, equations, algorithms, figures; of one key the later family
    in this order stands. Ids are hashes of artifact and key."""
    s = doc_spans(spark, folder).select("artifact_id", F.lit(1).alias("rank"), F.lit("SPAN").alias("family"), F.col("span_id").alias("key"), "page")
    e = doc_equations(spark, folder).filter("definition_id is not null").select("artifact_id", F.lit(2).alias("rank"), F.lit("EQUATION").alias("family"), F.concat(F.lit("eq:"), "label").alias("key"), "page")
    a = doc_algorithms(spark, folder).select("artifact_id", F.lit(3).alias("rank"), F.lit("ALGORITHM").alias("family"), F.col("unit").alias("key"), "page")
    pages = blocks(spark, folder).select("artifact_id", "block_id", "page")
    f = doc_figures(spark, folder).join(pages, ["artifact_id", "block_id"]).groupBy("artifact_id", F.concat(F.lit("fig:"), "number").alias("key")).agg(F.min("page").alias("page"))
    f = f.select("artifact_id", F.lit(4).alias("rank"), F.lit("FIGURE").alias("family"), "key", "page")
    best = s.unionByName(e).unionByName(a).unionByName(f).groupBy("artifact_id", "key").agg(F.max_by(F.struct("family", "page"), F.struct("rank", "page")).alias("r"))
    return best.select(F.concat(F.lit("src_"), F.substring(F.sha2(F.concat_ws("|", "artifact_id", "key"), 256), 1, 24)).alias("source_id"), "artifact_id", "key", "r.family", "r.page")


def doc_profile_issues(spark: SparkSession, folder: str) -> DataFrame:
    """How many profiles have which issue in their findings; and how many are valid as they are."""
    found = table(spark, folder, "paper_memory").select(V.claim_issues(V.parsed_claims("profile_json", "keyFindings")).alias("issues"))
    named = F.when(F.size("issues") == 0, F.array(F.lit("VALID"))).otherwise(F.col("issues"))
    return found.select(F.explode(named).alias("issue")).groupBy("issue").agg(F.count("*").alias("profiles"))


def doc_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of every profile after repair: claims, mean confidence, evidence ids."""
    c = table(spark, folder, "paper_memory").select("id", F.explode(V.repaired_claims(V.parsed_claims("profile_json", "keyFindings"))).alias("c"))
    return c.groupBy("id").agg(F.count("*").alias("claims"), F.round(F.avg("c.confidence"), 6).alias("confidence"), F.sum(F.size("c.evidenceBlockIds")).cast("bigint").alias("ids"))


def doc_grounded(spark: SparkSession, folder: str) -> DataFrame:
    """Findings per profile: claims, those with evidence, and those all of whose evidence a layout of the paper has."""
    m = table(spark, folder, "paper_memory").select("id", "paper_id", F.posexplode(V.repaired_claims(V.parsed_claims("profile_json", "keyFindings"))).alias("no", "c"))
    claims = m.select(F.struct("id", "no").alias("claim_id"), "paper_id", F.col("c.evidenceBlockIds").alias("ids"))
    g = V.grounded(claims, blocks(spark, folder).select("paper_id", "block_id"), ["paper_id"])
    return g.groupBy(F.col("claim_id.id").alias("id")).agg(F.count("*").alias("claims"), F.count_if(F.col("ids") > 0).alias("with_evidence"), F.count_if((F.col("ids") > 0) & (F.col("ids") == F.col("known_ids"))).alias("grounded"))


def queries() -> dict:
    """The queries of this module."""
    return {n: f for n, f in globals().items() if n.startswith("doc_")}


_B = """raw AS (SELECT id AS artifact_id, paper_id, page_count AS pages, unnest(CASE WHEN json_valid(blocks_json) AND json_type(blocks_json) = 'ARRAY' THEN CAST(blocks_json AS JSON[]) END) AS j FROM paper_layout_artifact),
blocks AS (SELECT artifact_id, paper_id, pages, j ->> 'id' AS block_id, CAST(j ->> 'page' AS INTEGER) AS page, CAST(j ->> 'readingOrder' AS INTEGER) AS ord, j ->> 'role' AS role, j ->> 'contentMode' AS mode,
  coalesce(array_to_string(CAST(j ->> 'sectionPath' AS VARCHAR[]), ' / '), '') AS section, coalesce(j ->> 'text', '') AS text, coalesce(j ->> 'latex', '') AS latex, CAST(j ->> 'confidence' AS DOUBLE) AS confidence,
  CAST(j -> 'bbox' ->> 'x' AS DOUBLE) AS x, CAST(j -> 'bbox' ->> 'y' AS DOUBLE) AS y, CAST(j -> 'bbox' ->> 'width' AS DOUBLE) AS w, CAST(j -> 'bbox' ->> 'height' AS DOUBLE) AS h FROM raw),
boxed AS (SELECT *, CASE WHEN w >= 0.55 OR page = 1 AND y < 0.32 AND abs(x + w / 2 - 0.5) <= 0.14 THEN 'FULL' WHEN x + w / 2 < 0.5 THEN 'LEFT' ELSE 'RIGHT' END AS lane,
  coalesce(x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 1.000001 AND y + h <= 1.000001, false) AS valid FROM blocks)"""
_E = """parsed AS (SELECT id AS memory_id, paper_id, CASE WHEN json_valid(structure_json) THEN CAST(structure_json AS JSON) END AS s FROM paper_memory),
sections AS (SELECT memory_id, unnest(CAST(s -> 'sections' AS JSON[])) AS x, generate_subscripts(CAST(s -> 'sections' AS JSON[]), 1) - 1 AS pos FROM parsed WHERE s IS NOT NULL),
elements AS (SELECT memory_id, paper_id, unnest(CAST(s -> 'elements' AS JSON[])) AS e, generate_subscripts(CAST(s -> 'elements' AS JSON[]), 1) - 1 AS pos, CAST(s ->> 'pageCount' AS INTEGER) AS pages FROM parsed WHERE s IS NOT NULL)"""
_C = """lists AS (SELECT id, paper_id, CASE WHEN json_valid(profile_json) AND json_type(profile_json, '$.keyFindings') = 'ARRAY' THEN CAST(json_extract(profile_json, '$.keyFindings') AS JSON[]) END AS l FROM paper_memory),
flat AS (SELECT id, paper_id, unnest(l) AS c, generate_subscripts(l, 1) AS no FROM lists),
claims AS (SELECT *, list_distinct(list_filter(list_transform(CASE json_type(c, '$.evidenceBlockIds') WHEN 'ARRAY' THEN CAST(c ->> 'evidenceBlockIds' AS VARCHAR[]) ELSE [] END, lambda x: trim(x)), lambda x: x <> '')) AS ids
  FROM flat WHERE trim(coalesce(c ->> 'statement', '')) <> '')"""
_ENDS = "regexp_matches({}, '[.!?。！？]\\s*$')"
_OVER = """touching AS (SELECT * FROM (SELECT a.artifact_id, a.page, a.block_id AS a_id, b.block_id AS b_id,
  round(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / least(a.w * a.h, b.w * b.h), 6) AS share
  FROM boxed a JOIN boxed b ON a.artifact_id = b.artifact_id AND a.page = b.page AND a.block_id < b.block_id WHERE a.valid AND b.valid) WHERE share >= 0.55)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB texts with the same results; spans are a fold and are tested by brute force."""
    upper = "length(regexp_replace(t, '[^\\p{Lu}]', '', 'g'))"
    letters = "length(regexp_replace(t, '[^\\p{L}]', '', 'g'))"
    heading = f"""(length(text) <= 140 AND t <> '' AND (regexp_matches(t, '^(?:(?:[IVXLC]+|\\d+(?:\\.\\d+)*)\\.?\\s+\\p{{Lu}}.*|(?i:appendix)(?:\\s+[A-Z])?\\s*.*)$')
  OR ({letters} >= 4 AND length(t) <= 80 AND {upper} >= ceil({letters} * 0.85) AND len(str_split(t, ' ')) <= 12)))"""
    formula = f"(length(text) <= 220 AND t <> '' AND length(regexp_replace(text, '[^=<>±×÷∑∫√∞≈≤≥^_{{}}\\[\\]|]', '', 'g')) >= 2 AND {letters} / length(text) < 0.68)"
    space = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"
    signs = [" AND ".join(f"regexp_matches(x, '{p}')" for p in kind) for kind in D.WORD_SIGNS]
    q = "the citation window drifts over time"
    tokens = f"list_distinct(list_filter(regexp_extract_all(lower({T.sql_unified('text')}), " + "'[\\p{Han}]+|[\\p{Latin}\\p{N}_-]+|[\\p{Greek}\\p{N}]+'), lambda x: length(x) > 1))"
    return {
        "doc_blocks": f"WITH {_B} SELECT artifact_id, block_id, lane, round(greatest(w, 0) * greatest(h, 0), 8) AS area, valid, w >= 0.005 AND h >= 0.003 AND greatest(w, 0) * greatest(h, 0) <= 0.35 AND h <= 0.60 AS region FROM boxed",
        "doc_roles": f"WITH {_B} SELECT artifact_id, role, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS characters FROM blocks GROUP BY ALL",
        "doc_pages": f"""WITH {_B}, p AS (SELECT id AS artifact_id, unnest(generate_series(1, page_count)) AS page FROM paper_layout_artifact WHERE page_count > 0)
SELECT p.artifact_id, CAST(p.page AS INTEGER) AS page, count(b.artifact_id) AS blocks, min(ord) AS first_ord, max(ord) AS last_ord, count(*) FILTER (role = 'HEADING') AS headings
FROM p LEFT JOIN blocks b ON p.artifact_id = b.artifact_id AND p.page = b.page GROUP BY ALL""",
        "doc_quality": f"""WITH {_B}, q AS (SELECT artifact_id, count(*) AS blocks, round(avg(confidence), 6) AS confidence, count(*) FILTER (confidence < 0.5) AS doubtful,
  count(*) FILTER (mode = 'REGION') AS regions, count(*) FILTER (NOT length(trim(text, ' ')) > 0) AS blank FROM blocks GROUP BY artifact_id)
SELECT *, concat_ws(',', CASE WHEN confidence < 0.62 THEN 'LOW_CONFIDENCE' END, CASE WHEN regions * 2 > blocks THEN 'MOSTLY_REGIONS' END, CASE WHEN blank > 0 THEN 'BLANK_BLOCKS' END) AS issues FROM q""",
        "doc_score": f"""WITH {_B}, n AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY ord, block_id) - 1 AS no,
  length(text) - length(regexp_replace(text, '[\\x{{FFFD}}\\x{{00}}-\\x{{08}}\\x{{0E}}-\\x{{1B}}]', '', 'g')) AS bad FROM boxed),
s AS (SELECT artifact_id, CAST(sum(length(text)) AS BIGINT) AS characters, avg(CAST(valid AS DOUBLE)) AS geometry, avg(confidence) AS confidence, coalesce(1 - sum(bad) / nullif(sum(length(text)), 0), 0) AS clean, avg(CAST(ord = no AS DOUBLE)) AS o FROM n GROUP BY 1),
r AS (SELECT s.*, 0.28 * a.layout_confidence + 0.24 * least(1, greatest(0, characters / greatest(page_count, 1) / 650.0)) + 0.16 * geometry + 0.14 * clean + 0.12 * confidence + 0.06 * o AS raw FROM s JOIN paper_layout_artifact a ON a.id = s.artifact_id),
t AS (SELECT artifact_id, characters, clean, round(least(1, greatest(0, CASE WHEN characters = 0 THEN least(raw, 0.15) ELSE raw END - CASE WHEN clean < 0.94 THEN 0.08 ELSE 0 END)), 5) AS score FROM r)
SELECT artifact_id, characters, score, score < 0.68 OR clean < 0.94 OR characters = 0 AS fallback FROM t""",
        "doc_order": f"""WITH {_B}, s AS (SELECT artifact_id, page, lag(y) OVER (PARTITION BY artifact_id, page, lane ORDER BY ord, block_id) > y + 0.005 AS up FROM boxed WHERE valid AND role NOT IN ('HEADER', 'FOOTER', 'MARGIN_METADATA')),
p AS (SELECT artifact_id, page, count(up) AS steps, count(*) FILTER (up) AS ups FROM s GROUP BY ALL)
SELECT artifact_id, CAST(sum(ups) AS BIGINT) AS ups, round(max(coalesce(ups / nullif(steps, 0), 0)), 6) AS worst FROM p GROUP BY artifact_id""",
        "doc_medians": f"WITH {_B} SELECT artifact_id, role, round(median(h), 6) AS height, round(median(w), 6) AS width FROM blocks GROUP BY ALL",
        "doc_envelopes": f"WITH {_B} SELECT artifact_id, page, lane, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x + w), 6) AS x1, round(max(y + h), 6) AS y1 FROM boxed WHERE valid GROUP BY ALL",
        "doc_furniture": f"""WITH {_B}, f AS (SELECT artifact_id, page, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\d+', '#', 'g'), '[^\\p{{L}}#]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS print FROM blocks)
SELECT artifact_id, sha256(print) AS print, count(DISTINCT page) AS pages, count(*) AS blocks FROM f WHERE print <> '' GROUP BY artifact_id, f.print HAVING count(DISTINCT page) >= 2""",
        "doc_math": f"""WITH {_B}, w AS (SELECT artifact_id, block_id, regexp_extract_all(text, '\\S+') AS ws, length(regexp_replace(text, '\\s+', '', 'g')) AS ink FROM blocks),
m AS (SELECT *, {" + ".join(f"len(list_filter(ws, lambda x: {p}))" for p in signs)} AS signals, list_filter(ws, lambda x: {" OR ".join(f"({p})" for p in signs)}) AS hit,
  len(regexp_extract_all(array_to_string(list_transform(ws, lambda x: CASE WHEN {" OR ".join(f"({p})" for p in signs)} THEN 'S' ELSE 'n' END), ''), 'S+')) AS fragments FROM w),
d AS (SELECT *, round(CASE WHEN ink > 0 THEN least(1.0, length(array_to_string(hit, '')) / ink) ELSE 0.0 END, 6) AS density FROM m)
SELECT artifact_id, block_id, CASE WHEN signals >= 4 AND (fragments >= 2 OR density >= 0.12) THEN 'MATH_RICH' WHEN signals > 0 THEN 'LIGHT' ELSE 'NONE' END AS level, CAST(signals AS INTEGER) AS signals, CAST(fragments AS INTEGER) AS fragments, CAST(density AS DOUBLE) AS density FROM d""",
        "doc_read_roles": f"""WITH {_B}, a AS (SELECT *, trim(text, ' ') AS tt, role IN ('HEADER', 'FOOTER', 'MARGIN_METADATA') AS furniture, {space.format('text')} AS t FROM boxed),
b AS (SELECT *, last(CASE WHEN NOT furniture THEN lane END IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lane_before FROM a),
c AS (SELECT *, sum(CASE WHEN NOT furniture AND (page <> 1 OR lane_before IS DISTINCT FROM lane) THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS UNBOUNDED PRECEDING) AS stretch FROM b),
d AS (SELECT *, NOT furniture AND page = 1 AND max(NOT furniture AND page = 1 AND regexp_matches(tt, '{D.FOOTNOTE}')) OVER (PARTITION BY artifact_id, stretch ORDER BY ord, block_id ROWS UNBOUNDED PRECEDING) AS foot FROM c),
e AS (SELECT *, NOT furniture AND NOT foot AND role <> 'REFERENCE' AND regexp_matches(tt, '{D.REFERENCES}') AS ref_line FROM d),
f AS (SELECT *, coalesce(max(ref_line) OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_refs FROM e),
g AS (SELECT *, NOT (furniture OR foot OR after_refs OR ref_line OR role IN ('TITLE', 'AUTHOR', 'REFERENCE')) AS live, regexp_matches(t, '{D.LABEL}') AND regexp_matches(t, '{D.OPERATOR}') AND NOT regexp_matches(t, '{D.MENTION}') AS display,
  role = 'HEADING' OR ({heading}) OR regexp_matches(tt, '{D.THEOREM}') AS heads, regexp_matches(tt, '{D.KEYWORDS}') AS keywords FROM f),
h AS (SELECT *, live AND (role = 'ABSTRACT' OR regexp_matches(tt, '{D.ABSTRACT}')) AS opens FROM g),
i AS (SELECT *, CASE WHEN opens THEN true WHEN foot OR live AND NOT keywords AND (display OR heads) THEN false END AS mark FROM h),
j AS (SELECT *, coalesce(last(mark IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM i),
k AS (SELECT *, CASE WHEN furniture THEN role WHEN foot THEN 'MARGIN_METADATA' WHEN after_refs OR role = 'REFERENCE' THEN 'REFERENCE' WHEN ref_line THEN 'HEADING' WHEN role IN ('TITLE', 'AUTHOR') THEN role
  WHEN opens OR inside AND keywords THEN 'ABSTRACT' WHEN NOT inside AND role IN ('TABLE', 'FIGURE') THEN role WHEN NOT inside AND (role = 'CAPTION' OR regexp_extract(tt, '{D.FIGURE}', 2) <> '' OR regexp_matches(tt, '{D.TABLE}')) THEN 'CAPTION'
  WHEN NOT inside AND regexp_matches(tt, '{D.FIGURE}') THEN 'BODY' WHEN display THEN 'FORMULA' WHEN heads THEN 'HEADING' WHEN inside THEN 'ABSTRACT'
  WHEN role = 'FORMULA' OR trim(latex, ' ') <> '' OR ({formula}) AND NOT regexp_matches(tt, '{D.MENTION}') THEN 'FORMULA' ELSE 'BODY' END AS told FROM j)
SELECT artifact_id, block_id, told AS role, CASE WHEN told IN ('TITLE', 'AUTHOR', 'HEADER', 'FOOTER', 'MARGIN_METADATA') THEN '' ELSE coalesce(last(CASE WHEN told = 'HEADING' THEN tt WHEN opens THEN 'Abstract' END IGNORE NULLS)
  OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS UNBOUNDED PRECEDING), '') END AS section FROM k""",
        "doc_lines": f"""WITH {_B}, c AS (SELECT role, text, {space.format('text')} AS t FROM blocks)
SELECT role, count(*) AS blocks, count(*) FILTER ({heading}) AS headings, count(*) FILTER ({formula}) AS formulas, count(*) FILTER ({_ENDS.format('text')}) AS sentences FROM c GROUP BY role""",
        "doc_headings": f"""WITH {_B}, f AS (SELECT *, last(CASE WHEN role = 'HEADING' THEN block_id END IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS UNBOUNDED PRECEDING) AS heading_id FROM blocks)
SELECT artifact_id, block_id, heading_id FROM f WHERE role IN ('BODY', 'ABSTRACT')""",
        "doc_paragraphs": f"""WITH {_B}, p AS (SELECT *, CASE WHEN lag(page) OVER w = page AND lag(lane) OVER w = lane AND lag(section) OVER w = section AND NOT regexp_matches(lag(text) OVER w, '[.!?。！？]\\s*$') THEN 0 ELSE 1 END AS start
  FROM boxed WHERE role = 'BODY' WINDOW w AS (PARTITION BY artifact_id ORDER BY ord, block_id)),
n AS (SELECT *, CAST(sum(start) OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM p)
SELECT artifact_id, paragraph, min(page) AS page, count(*) AS blocks, CAST(length(regexp_replace(string_agg(text, chr(10) ORDER BY ord, block_id), '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g')) AS BIGINT) AS characters FROM n GROUP BY artifact_id, paragraph""",
        "doc_captions": f"""WITH {_B}, g AS (SELECT a.artifact_id, a.block_id, o.block_id AS other_id, round(a.y - (o.y + o.h), 6) AS gap, a.y - (o.y + o.h) AS raw_gap FROM boxed a JOIN boxed o ON a.artifact_id = o.artifact_id AND a.page = o.page
  WHERE a.role = 'CAPTION' AND o.role IN ('TABLE', 'FORMULA', 'FIGURE') AND least(a.x + a.w, o.x + o.w) > greatest(a.x, o.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, block_id ORDER BY gap, other_id) AS rn FROM g WHERE raw_gap BETWEEN -0.01 AND 0.3)
SELECT c.artifact_id, c.block_id, r.other_id, r.gap FROM (SELECT artifact_id, block_id FROM blocks WHERE role = 'CAPTION') c LEFT JOIN r ON c.artifact_id = r.artifact_id AND c.block_id = r.block_id AND rn = 1""",
        "doc_owners": f"""WITH {_B}, o AS (SELECT *, last(CASE WHEN role = 'HEADING' THEN {{'b': block_id, 'p': page}} END IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM blocks)
SELECT artifact_id, block_id, CASE WHEN page - own.p <= 1 THEN own.b END AS owner_id FROM o WHERE role = 'FORMULA'""",
        "doc_neighbours": f"""WITH {_B}, m AS (SELECT *, CASE WHEN role IN ('BODY', 'ABSTRACT') AND length(trim(text, ' ')) > 0 THEN block_id END AS c FROM blocks),
n AS (SELECT *, last(c IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_id,
  first(c IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY ord, block_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_id FROM m)
SELECT artifact_id, block_id, before_id, after_id FROM n WHERE role = 'TABLE'""",
        "doc_overlaps": f"WITH {_B}, {_OVER} SELECT artifact_id, page, a_id, b_id, share FROM touching",
        "doc_best_overlap": f"""WITH {_B}, {_OVER}, u AS (SELECT artifact_id, a_id AS block_id, b_id AS other_id, share FROM touching UNION ALL SELECT artifact_id, b_id, a_id, share FROM touching)
SELECT artifact_id, block_id, other_id, share FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, block_id ORDER BY share DESC, other_id) AS rn FROM u) WHERE rn = 1""",
        "doc_selection": f"""WITH {_B}, q AS (SELECT ['the', 'citation', 'window', 'drifts', 'over', 'time'] AS tk),
s AS (SELECT artifact_id, block_id, round(0.78 * coalesce(greatest(least(0.6, x + w) - greatest(0.1, x), 0) * greatest(least(0.6, y + h) - greatest(0.2, y), 0) / nullif(greatest(w, 0) * greatest(h, 0), 0), 0)
  + 0.22 * CASE WHEN regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') = '' THEN 0 WHEN contains(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), '{q.replace(' ', '')}') THEN 1
    ELSE len(list_intersect((SELECT tk FROM q), {tokens})) / 6 END, 6) AS score FROM blocks WHERE page = 1)
SELECT artifact_id, block_id, score FROM (SELECT *, max(score) OVER (PARTITION BY artifact_id) AS best FROM s) WHERE score >= 0.28 AND score >= 0.52 * best""",
        "doc_copies": f"""WITH {_B}, k AS (SELECT artifact_id, block_id, confidence, length(text) AS n, 'ev_' || substr(sha256(concat_ws('|', CAST(paper_id AS VARCHAR), {space.format('lower(text)')})), 1, 24) AS key FROM blocks WHERE length(trim(text, ' ')) > 0)
SELECT artifact_id, block_id, key, count(*) OVER (PARTITION BY key) AS copies, row_number() OVER (PARTITION BY key ORDER BY confidence DESC, n DESC, artifact_id, block_id) = 1 AS kept FROM k""",
        "doc_references": f"""WITH {_B}, r AS (SELECT paper_id, artifact_id, block_id, 'FIGURE' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(text, '{T.sql_pattern(T.FIGURES)}', 1), lambda x: lower(x)))) AS number FROM blocks
  UNION ALL SELECT paper_id, artifact_id, block_id, 'FORMULA', unnest(list_distinct(list_transform(regexp_extract_all(text, '{T.sql_pattern(T.FORMULAS)}', 1), lambda x: lower(x)))) FROM blocks)
SELECT paper_id, kind, number, count(*) AS blocks, count(DISTINCT artifact_id) AS artifacts FROM r GROUP BY ALL""",
        "doc_families": f"""WITH {_B}, l AS (SELECT DISTINCT artifact_id, unnest(regexp_extract_all(text || ' ' || latex, '\\((\\d{{1,4}}[a-z]?)\\)', 1)) AS label FROM blocks)
SELECT artifact_id, regexp_extract(label, '^(\\d+)', 1) AS base, count(*) AS members, min(label) AS first_label, max(label) AS last_label FROM l GROUP BY ALL""",
        "doc_evidence_keys": f"""WITH {_B} SELECT artifact_id, block_id, 'ev_' || substr(sha256(concat_ws('|', CAST(paper_id AS VARCHAR), role, concat_ws(':', CAST(page AS VARCHAR), printf('%.5f', x), printf('%.5f', y), printf('%.5f', w), printf('%.5f', h)))), 1, 24) AS evidence_key FROM blocks""",
        "doc_repaired": f"WITH {_C} SELECT id, count(*) AS claims, round(avg(least(1, greatest(0, coalesce(CAST(c ->> 'confidence' AS DOUBLE), 0.5)))), 6) AS confidence, CAST(sum(len(ids)) AS BIGINT) AS ids FROM claims GROUP BY id",
        "doc_grounded": f"""WITH {_C}, {_B}, g AS (SELECT id, no, len(ids) AS n, (SELECT count(*) FROM (SELECT unnest(ids) AS i) WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.paper_id = claims.paper_id AND b.block_id = i)) AS k FROM claims)
SELECT id, count(*) AS claims, count(*) FILTER (n > 0) AS with_evidence, count(*) FILTER (n > 0 AND n = k) AS grounded FROM g GROUP BY id""",
        "doc_reading_order": f"""WITH {_B}, r AS (SELECT *, sum(CASE WHEN lane = 'FULL' THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id, page ORDER BY y, x, block_id ROWS UNBOUNDED PRECEDING) AS region FROM boxed WHERE valid)
SELECT artifact_id, block_id, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY page, region, CASE lane WHEN 'FULL' THEN 0 WHEN 'LEFT' THEN 1 ELSE 2 END, y, x, block_id) AS INTEGER) AS place FROM r""",
        "doc_render": f"""WITH {_B}, t AS (SELECT artifact_id, string_agg('[' || block_id || ', ' || page || ', ' || role || '] ' || text, chr(10) ORDER BY ord, block_id) AS t FROM blocks
  WHERE role NOT IN ('FOOTER', 'HEADER', 'MARGIN_METADATA') AND length(trim(text, ' ')) > 0 GROUP BY artifact_id) SELECT artifact_id, length(t) AS characters, sha256(t) AS hash FROM t""",
        "doc_mode": f"""WITH {_B}, s AS (SELECT artifact_id, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (mode = 'REGION') AS regions, count(*) AS n FROM blocks GROUP BY 1)
SELECT artifact_id, characters, CASE WHEN regions * 2 > n THEN 'VISUAL' WHEN characters <= 4000 THEN 'WHOLE' ELSE 'PARTS' END AS mode, CAST(greatest(0, least(60, floor((90000 - characters / 4) / 1024))) AS BIGINT) AS visual_parts FROM s""",
        "doc_uncertain": f"""WITH {_B}, m AS (SELECT *, coalesce(lag(lane) OVER w = 'RIGHT' AND lane = 'LEFT' AND y <= lag(y) OVER w + lag(h) OVER w + 0.005, false) AS back FROM boxed WHERE valid WINDOW w AS (PARTITION BY artifact_id, page ORDER BY ord, block_id))
SELECT artifact_id, page, count(*) FILTER (confidence < 0.45) AS doubtful, count(*) FILTER (back) AS backward FROM m GROUP BY ALL HAVING count(*) FILTER (confidence < 0.45) > 0 OR count(*) FILTER (back) > 0""",
        "doc_continuations": f"""WITH {_B}, p AS (SELECT *, lag(block_id) OVER w AS from_id, lag(page) OVER w AS from_page, lag(text) OVER w AS from_text FROM blocks WHERE role IN ('BODY', 'ABSTRACT') AND length(trim(text, ' ')) > 0
  WINDOW w AS (PARTITION BY artifact_id ORDER BY ord, block_id))
SELECT artifact_id, from_id, block_id AS to_id, CAST(CASE WHEN regexp_matches(text, '^\\s*\\p{{Ll}}') THEN 0.92 ELSE 0.76 END AS DOUBLE) AS confidence FROM p WHERE page = from_page + 1 AND NOT {_ENDS.format('from_text')}""",
        "doc_runs": f"""WITH {_B}, p AS (SELECT DISTINCT artifact_id, page FROM blocks WHERE role = 'TABLE'), r AS (SELECT *, page - row_number() OVER (PARTITION BY artifact_id ORDER BY page) AS run FROM p)
SELECT artifact_id, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM r GROUP BY artifact_id, run""",
        "doc_languages": f"""WITH {_B}, l AS (SELECT text, length(regexp_replace(text, '[^\\p{{Han}}]', '', 'g')) AS han, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
  1 - (length(text) - length(regexp_replace(text, '[\\x{{FFFD}}\\p{{Co}}\\x{{00}}-\\x{{08}}\\x{{0E}}-\\x{{1B}}\\x{{7F}}-\\x{{84}}\\x{{86}}-\\x{{9F}}]', '', 'g'))) / nullif(length(text), 0) AS clean FROM blocks)
SELECT CASE WHEN han >= 2 AND han >= latin * 0.12 THEN 'ZH' ELSE 'EN' END AS language, count(*) AS blocks, round(avg(clean), 6) AS clean FROM l GROUP BY 1""",
        "doc_versions": "SELECT paper_id, id, document_hash, parser_version, layout_confidence FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY id DESC) AS rn FROM paper_layout_artifact WHERE status = 'READY') WHERE rn = 1",
        "doc_store": "SELECT paper_id, document_hash, parser_version, max(id) AS id, count(*) AS stored, arg_max(status, id) AS status FROM paper_layout_artifact GROUP BY ALL",
        "doc_bound": """SELECT status, count(*) AS memories, count(*) FILTER (b) AS bound, count(*) FILTER (NOT b) AS stale FROM (SELECT m.status, EXISTS (SELECT 1 FROM paper_layout_artifact a
WHERE a.paper_id = m.paper_id AND a.document_hash = m.document_hash AND a.parser_version = m.layout_parser_version) AS b FROM paper_memory m) GROUP BY status""",
        "doc_sections": f"""WITH {_E}, f AS (SELECT memory_id, pos, x ->> 'id' AS section_id, coalesce(CAST(x ->> 'level' AS INTEGER), 1) AS level FROM sections)
SELECT a.memory_id, a.section_id, (SELECT arg_max(b.section_id, b.pos) FROM f b WHERE b.memory_id = a.memory_id AND b.pos < a.pos AND b.level < a.level) AS parent_id FROM f a""",
        "doc_elements": f"WITH {_E} SELECT memory_id, e ->> 'type' AS type, count(*) AS elements, CAST(sum(length(e ->> 'content')) AS BIGINT) AS characters, min(CAST(e ->> 'page' AS INTEGER)) AS first_page FROM elements GROUP BY ALL",
        "doc_projection": f"""WITH {_E}, c AS (SELECT memory_id, e ->> 'content' AS content, min(pos) AS pos FROM elements WHERE trim(e ->> 'content', ' ') <> '' GROUP BY memory_id, e ->> 'content'),
t AS (SELECT memory_id, substr(string_agg(content, chr(10) ORDER BY pos), 1, 12000) AS t FROM c GROUP BY memory_id) SELECT memory_id, length(t) AS characters, sha256(t) AS hash FROM t""",
        "doc_block_members": f"""WITH {_B}, {_E}, l AS (SELECT DISTINCT memory_id, paper_id, pos, e ->> 'id' AS element_id, unnest(CAST(e ->> 'blockIds' AS VARCHAR[])) AS block_id FROM elements)
SELECT memory_id, count(*) AS links, count(*) FILTER (EXISTS (SELECT 1 FROM blocks b WHERE b.paper_id = l.paper_id AND b.block_id = l.block_id)) AS known, count(DISTINCT element_id) AS elements FROM l GROUP BY memory_id""",
        "doc_violations": f"""WITH {_E}, v AS (
SELECT memory_id, 'element_without_id' AS violation, count(*) AS n FROM elements WHERE coalesce(e ->> 'id', '') = '' GROUP BY 1
UNION ALL SELECT memory_id, 'element_repeated', count(*) - count(DISTINCT coalesce(e ->> 'id', '')) FROM elements GROUP BY 1
UNION ALL SELECT memory_id, 'element_without_blocks', count(*) FROM elements WHERE coalesce(len(CAST(e ->> 'blockIds' AS VARCHAR[])), 0) = 0 GROUP BY 1
UNION ALL SELECT memory_id, 'element_page', count(*) FROM elements WHERE CAST(e ->> 'page' AS INTEGER) < 1 OR CAST(e ->> 'page' AS INTEGER) > pages GROUP BY 1
UNION ALL SELECT memory_id, 'element_blank', count(*) FROM elements WHERE coalesce(trim(e ->> 'content', ' '), '') = '' GROUP BY 1
UNION ALL SELECT memory_id, 'element_type', count(*) FROM elements WHERE coalesce(trim(e ->> 'type', ' '), '') = '' GROUP BY 1
UNION ALL SELECT memory_id, 'element_order', count(*) - count(DISTINCT coalesce(e ->> 'readingOrder', '')) FROM elements GROUP BY 1
UNION ALL SELECT memory_id, 'section_without_id', count(*) FROM sections WHERE coalesce(x ->> 'id', '') = '' GROUP BY 1
UNION ALL SELECT memory_id, 'section_repeated', count(*) - count(DISTINCT coalesce(x ->> 'id', '')) FROM sections GROUP BY 1
UNION ALL SELECT memory_id, 'section_level', count(*) FROM sections WHERE coalesce(CAST(x ->> 'level' AS INTEGER), 0) < 1 GROUP BY 1
UNION ALL SELECT memory_id, 'section_parent', count(*) FROM sections a WHERE coalesce(x ->> 'parentId', '') <> '' AND NOT EXISTS (SELECT 1 FROM sections b WHERE b.memory_id = a.memory_id AND b.x ->> 'id' = a.x ->> 'parentId') GROUP BY 1)
SELECT memory_id, violation, n FROM v WHERE n > 0""",
    }
