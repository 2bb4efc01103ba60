"""What the lines of a document are: roles with sections, captions with their continuations, mathematics. All columns.

Windows run over a document and joins over a page, which are bounded: one JSON value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as T
from paperloom.operators.layout import FURNITURE

# ---- Fixed values: shapes of lines -----------------------------------------------------------------------------------
ABSTRACT = r"(?i)^\s*(?:abstract|summary)\b"
KEYWORDS = r"(?i)^\s*(?:index\s+terms?|key\s*words?)\b"
REFERENCES = r"(?i)^\s*(?:(?:[IVXLC]+|\d+)\.?\s+)?(?:references|bibliography)\s*$"
TABLE = r"(?i)^\s*table\s+(?:[IVXLC]+|\d+)[.:\s]"
FIGURE = r"(?i)^\s*(?:fig(?:ure)?\.?)\s*([\dIVX]+[a-z]?)(?:\s*([.:–—-])\s*|\s+)\S"
FOOTNOTE = r"(?i)^\s*(?:manuscript\s+received|this\s+work\s+was\s+supported|corresponding\s+author|the\s+authors?\s+(?:is|are)\s+with)\b"
THEOREM = r"(?i)^\s*(?:proof\s+of\s+)?(?:lemma|theorem|proposition|corollary)\s*\d+"
LABEL = r"\(\d{1,4}[a-z]?\)"
OPERATOR = r"(?i)[=≈≃≤≥<>∑∏√+−]|\b(?:max|min|argmax|argmin)\b"
MENTION = r"(?i)(?:in|from|using|by|see|shown\s+in|calculated\s+by|given\s+in|equation|eq\.)\s*\(\d{1,4}[a-z]?\)\s*[.,;:]?\s*$"
#: What makes a word mathematical; each kind counts once a word. All of a kind's patterns must be found.
WORD_SIGNS = (
    (r"[\x{2200}-\x{22FF}\x{27C0}-\x{27EF}\x{2980}-\x{2AFF}±×÷]",),
    (r"[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]",),
    (r"[\x{2070}-\x{209F}\x{1D400}-\x{1D7FF}]",),
    (r"[A-Za-z0-9][_=^][A-Za-z0-9{]",),
    (r"<=|>=|!=|:=|\+=|-=|[=<>±×÷∕]", r"[A-Za-z0-9_]"),
    (r"\$\$|\\(?:frac|sum|prod|mathbb|mathbf|mu|in)\b",),
)
#: Lines that continue a caption, one below the other.
RUN_ON = 5


def displays_equation(c: Column) -> Column:
    """Whether a line is a numbered display: a label and an operator, and no mention of another equation at the end."""
    t = T.collapsed(c)
    return F.coalesce(t.rlike(LABEL) & t.rlike(OPERATOR) & ~t.rlike(MENTION), F.lit(False))


# ---- mathematics -----------------------------------------------------------------------------------------------------
def math_profile(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(<keep>, level, signals, fragments, density) of the mathematics in the texts of a column.

    Signals are the signs of all words; words with signs that only up to four spaces, or two brackets between spaces, part
    are one fragment; density is the share of the ink that fragments have. Rich: four signals, and two fragments or a
    density of 0.12. A null text has none. One pass over the words of a text.
    """
    text = F.coalesce(column, F.lit(""))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"\s{5,}", " \u0001 "), r"\s+", " ")), " ")
    count = lambda w: reduce(lambda a, b: a + b, [reduce(lambda a, b: a & b, [w.rlike(p) for p in kind]).cast("int") for kind in WORD_SIGNS])
    told = F.transform(words, lambda w: F.struct(count(w).alias("n"), F.length(w).alias("ink"), w.rlike(r"^[,;:()\[\]{}]{1,2}$").alias("mark")))
    state = F.struct(F.lit(0).alias("signals"), F.lit(0).alias("inked"), F.lit(0).alias("fragments"), F.lit(False).alias("on"))

    def step(s: Column, x: Column) -> Column:
        has = x.n > 0
        return F.struct(
            (s.signals + x.n).alias("signals"), (s.inked + F.when(has, x.ink).otherwise(0)).alias("inked"),
            (s.fragments + (has & ~s.on).cast("int")).alias("fragments"), (has | (x.mark & s.on)).alias("on"),
        )

    m = df.select(*keep, F.aggregate(told, state, step).alias("_m"), F.length(F.regexp_replace(text, r"\s+", "")).alias("_ink"))
    m = m.select(*keep, "_m.signals", "_m.fragments", F.round(F.when(F.col("_ink") > 0, F.least(F.lit(1.0), F.col("_m.inked") / F.col("_ink"))).otherwise(0.0), 6).alias("density"))
    rich = (F.col("signals") >= 4) & ((F.col("fragments") >= 2) | (F.col("density") >= 0.12))
    return m.select(*keep, F.when(rich, "MATH_RICH").when(F.col("signals") > 0, "LIGHT").otherwise("NONE").alias("level"), "signals", "fragments", "density")


# ---- captions --------------------------------------------------------------------------------------------------------
def caption_lines(blocks: DataFrame) -> DataFrame:
    """(artifact_id, block_id, number, depth): the lines of figure captions with the figure's number.

    A line that begins with a figure is a caption if a separator follows the number or a figure region stands right
    above it; other such lines are discussion. A line below a caption's, in its column, section and margin, goes on with
    it: each such line points to the nearest line above, and up to ``RUN_ON`` pointers lead to the caption.
    """
    lead = F.regexp_extract("text", FIGURE, 1)
    b = blocks.select("artifact_id", "block_id", "page", "ord", "role", "mode", "section", "text", "x", "y", "w", "h", G.lane(F.col("page"), G.box()).alias("lane"), lead.alias("number"), (F.regexp_extract("text", FIGURE, 2) != "").alias("parted"))
    o = b.select("artifact_id", "page", *[F.col(c).alias(f"o_{c}") for c in ("block_id", "ord", "role", "mode", "section", "x", "y", "w", "h", "lane", "number")])
    shared = F.least(F.col("x") + F.col("w"), F.col("o_x") + F.col("o_w")) - F.greatest("x", "o_x")
    sideways = shared / F.greatest(F.lit(0.001), F.least("w", "o_w")) >= 0.5
    gap = F.greatest(F.lit(0.0), F.col("y") - F.col("o_y") - F.col("o_h"))
    columns = (F.col("lane") == F.col("o_lane")) | (F.col("lane") == "FULL") | (F.col("o_lane") == "FULL")
    stands_under = lambda by, most: sideways & columns & (F.col("o_y") + F.col("o_h") <= F.col("y") + by) & (gap <= most)
    near = b.filter("number != '' and not parted").join(o.filter("o_role = 'FIGURE' and o_mode = 'REGION'"), ["artifact_id", "page"]).filter(stands_under(0.006, 0.06))
    captions = b.filter("number != '' and parted").select("artifact_id", "block_id", "number").unionByName(near.select("artifact_id", "block_id", "number")).distinct()
    follows = stands_under(0.003, 0.014) & (F.col("o_ord") < F.col("ord")) & (F.col("section") == F.col("o_section")) & (F.abs(F.col("x") - F.col("o_x")) <= 0.035) & (F.col("h") <= F.greatest(F.lit(0.022), F.col("o_h") * 2.5))
    lines = b.filter("number = '' and role in ('CAPTION', 'BODY', 'FORMULA')").join(o, ["artifact_id", "page"]).filter(follows)
    above = lines.groupBy("artifact_id", "block_id").agg(F.min(F.struct(gap.alias("gap"), (-F.col("o_ord")).alias("o"), "o_block_id")).alias("m")).select("artifact_id", "block_id", F.col("m.o_block_id").alias("up"))
    # a document's pointers and numbers as maps, so that following pointers needs no more joins
    maps = above.select("artifact_id", "block_id", "up", F.lit(None).cast("string").alias("number")).unionByName(captions.withColumn("up", F.lit(None).cast("string")))
    once = maps.groupBy("artifact_id", "block_id").agg(F.max("up").alias("up"), F.max("number").alias("number"))
    entries = lambda c: F.map_from_entries(F.filter(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("block_id", c))), lambda x: x.isNotNull()))
    docs = once.groupBy("artifact_id").agg(entries("up").alias("ups"), entries("number").alias("numbers"), F.collect_list("block_id").alias("ids")).filter(F.size("numbers") > 0)
    held = docs.select("artifact_id", "ups", "numbers", F.explode("ids").alias("block_id"))
    at, found, depth = F.col("block_id"), F.element_at("numbers", F.col("block_id")), F.when(F.element_at("numbers", F.col("block_id")).isNotNull(), 0)
    for k in range(1, RUN_ON + 1):
        at = F.element_at("ups", at)
        depth = F.coalesce(depth, F.when(F.element_at("numbers", at).isNotNull(), k))
        found = F.coalesce(found, F.element_at("numbers", at))
    return held.select("artifact_id", "block_id", found.alias("number"), depth.alias("depth")).filter("number is not null")


# ---- roles -----------------------------------------------------------------------------------------------------------
def read_roles(blocks: DataFrame) -> DataFrame:
    """(artifact_id, block_id, role, section): roles told by line shapes and what came before, in reading order.

    What came before are four facts, each a window over the lines so far: a footnote runs on in its lane, the references
    have begun, an abstract is open (its last beginning is later than its last end), and the last heading. The first
    rule of a table that holds decides.
    """
    doc = Window.partitionBy("artifact_id").orderBy("ord", "block_id")
    so_far, before = doc.rowsBetween(Window.unboundedPreceding, 0), doc.rowsBetween(Window.unboundedPreceding, -1)
    t, given = F.col("t"), F.col("role")
    like = lambda p: F.coalesce(t.rlike(p), F.lit(False))
    ever = lambda c, over: F.coalesce(F.max(c).over(over), F.lit(False))
    furniture, named = given.isin(FURNITURE), given.isin("TITLE", "AUTHOR")
    b = blocks.select("artifact_id", "block_id", "page", "ord", "role", "latex", "text", F.trim("text").alias("t"), G.lane(F.col("page"), G.box()).alias("lane"))
    b = b.join(caption_lines(blocks).select("artifact_id", "block_id", F.lit(True).alias("caption")), ["artifact_id", "block_id"], "left")

    # a footnote of the first page: lines of one lane in a row, from the one that begins it
    turns = ~furniture & ((F.col("page") != 1) | ~F.coalesce(F.last(F.when(~furniture, F.col("lane")), ignorenulls=True).over(before) == F.col("lane"), F.lit(False)))
    b = b.withColumn("stretch", F.sum(turns.cast("int")).over(so_far))
    in_stretch = Window.partitionBy("artifact_id", "stretch").orderBy("ord", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("foot", ~furniture & (F.col("page") == 1) & ever(~furniture & (F.col("page") == 1) & like(FOOTNOTE), in_stretch))
    b = b.withColumn("ref_line", ~furniture & ~F.col("foot") & (given != "REFERENCE") & like(REFERENCES))
    b = b.withColumn("after_refs", ever(F.col("ref_line"), before))
    b = b.withColumn("live", ~(furniture | F.col("foot") | F.col("after_refs") | F.col("ref_line") | named) & (given != "REFERENCE"))
    live, display, heads = F.col("live"), displays_equation(t), (given == "HEADING") | T.is_heading(F.col("text")) | like(THEOREM)
    opens = live & ((given == "ABSTRACT") | like(ABSTRACT))
    ends = F.col("foot") | (live & ~opens & ~like(KEYWORDS) & (display | heads))
    b = b.withColumns({"opens": opens, "display": display, "heads": heads, "mark": F.when(opens, True).when(ends, False)})
    b = b.withColumn("inside", F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(False)))
    inside = F.col("inside")
    rules = [
        (furniture, given),
        (F.col("foot"), "MARGIN_METADATA"),
        (F.col("after_refs") | (given == "REFERENCE"), "REFERENCE"),
        (F.col("ref_line"), "HEADING"),
        (named, given),
        (F.col("opens") | (inside & like(KEYWORDS)), "ABSTRACT"),
        (~inside & given.isin("TABLE", "FIGURE"), given),
        (~inside & ((given == "CAPTION") | F.col("caption").isNotNull() | like(TABLE)), "CAPTION"),
        (~inside & like(FIGURE), "BODY"),
        (F.col("display"), "FORMULA"),
        (F.col("heads"), "HEADING"),
        (inside, "ABSTRACT"),
        ((given == "FORMULA") | (F.trim("latex") != "") | (T.is_formula(F.col("text")) & ~like(MENTION)), "FORMULA"),
    ]
    role = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), r if isinstance(r, Column) else F.lit(r)) for c, r in rules], F.lit("BODY"))
    told = b.withColumn("told", role)
    section = F.last(F.when(F.col("told") == "HEADING", t).when(F.col("opens"), "Abstract"), ignorenulls=True).over(so_far)
    nowhere = F.col("told").isin("TITLE", "AUTHOR", *FURNITURE)
    return told.select("artifact_id", "block_id", F.col("told").alias("role"), F.when(nowhere, "").otherwise(F.coalesce(section, F.lit(""))).alias("section"))
