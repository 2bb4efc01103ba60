"""Grounding: identity of evidence, physical copies, citation labels in answers, markers, context budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators.sequences import scan_groups
from paperloom.operators.units import LABEL, Block, each_document

#: How far the edges of two locators of one place may differ.
TOLERANCE = 0.012
#: Messages and characters a message that a context may have, the most generous first.
LADDER = ((8, 900), (6, 600), (4, 360), (2, 220))


def evidence_key(*parts: Column) -> Column:
    """A stable id of a piece of evidence from its document, version and sorted places; numbers as fixed decimals."""
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def place_text(page: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """A place as text with five decimals."""
    return F.concat_ws(":", page.cast("string"), *[F.format_string("%.5f", c) for c in (x, y, w, h)])


def same_place(a: Block, b: Block) -> bool:
    """Whether two places agree within the tolerance on every edge."""
    edges = ((a.x, b.x), (a.y, b.y), (a.x + a.w, b.x + b.w), (a.y + a.h, b.y + b.h))
    return a.page == b.page and all(abs(p - q) <= TOLERANCE for p, q in edges)


def _shared(a: Block, b: Block) -> float:
    wide = min(a.x + a.w, b.x + b.w) - max(a.x, b.x)
    high = min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
    return max(0.0, wide) * max(0.0, high) / max(1e-9, min(a.w * a.h, b.w * b.h)) if a.page == b.page else 0.0


def physical_copies(blocks: list[Block]) -> list[tuple[str, str]]:
    """(block_id, kept_id): each block with the block that stands for its place: equal texts that overlap by 0.90,
    displays of one number that overlap by 0.65 whatever their texts, or one place with a text that begins the other over
    40 characters. Better confidence, then the longer text, then
    reading order decides what is kept; later blocks are compared only with what is kept."""
    bare = {b.block_id: re.sub(r"\W+", "", b.text.lower()) for b in blocks}
    kept: list[Block] = []
    by_text: dict[str, list[Block]] = {}
    by_number: dict[str, list[Block]] = {}
    out = []
    for b in sorted(blocks, key=lambda b: (-b.confidence, -len(b.text), b.ord)):
        mine = bare[b.block_id]
        near = [k for k in by_text.get(mine, ()) if _shared(b, k) >= 0.90]
        numbers = set(LABEL.findall(f"{b.text} {b.latex}")) if b.role == "FORMULA" else ()
        if not near:
            near = [k for n in numbers for k in by_number.get(n, ()) if _shared(b, k) >= 0.65]
        if not near and len(mine) >= 40:
            near = [k for k in kept if same_place(b, k) and (bare[k.block_id].startswith(mine) or mine.startswith(bare[k.block_id])) and len(bare[k.block_id]) >= 40]
        if near:
            out.append((b.block_id, near[0].block_id))
        else:
            kept.append(b)
            by_text.setdefault(mine, []).append(b)
            for n in numbers:
                by_number.setdefault(n, []).append(b)
            out.append((b.block_id, b.block_id))
    return out


def drop_copies(blocks: DataFrame) -> DataFrame:
    """(artifact_id, block_id, kept_id): ``physical_copies`` of every document."""
    return each_document(blocks, physical_copies, "block_id string, kept_id string")


_CITATION = re.compile(r"\[S(\d{1,3})\]")
_FENCED = re.compile(r"```.*?```|`[^`\n]*`|\$\$.*?\$\$|\$[^$\n]*\$", re.S)


def citations(answer: str | None) -> Iterator[tuple[str, int, int]]:
    """(label, start, end): every citation label of an answer with the range of the sentence it closes, labels taken
    out of account as sentence marks; none inside code or mathematics."""
    text = answer or ""
    closed = [(m.start(), m.end()) for m in _FENCED.finditer(text)]
    start = 0
    for m in _CITATION.finditer(text):
        if any(a <= m.start() < b for a, b in closed):
            continue
        before = text[start : m.start()]
        cut = max((before.rstrip().rfind(c, 0, max(0, len(before.rstrip()) - 1)) for c in ".!?。！？\n"), default=-1)
        begin = start + cut + 1
        while begin < m.start() and text[begin].isspace():
            begin += 1
        yield f"S{m[1]}", begin, len(text[: m.start()].rstrip())
        if not _CITATION.match(text, m.end()):
            start = begin


def without_markers(answer: str | None) -> str | None:
    """An answer without its citation labels; those in code and mathematics stay."""
    if answer is None:
        return None
    out, at = [], 0
    for m in _FENCED.finditer(answer):
        out += [re.sub(r"\s*\[S\d{1,3}\]", "", answer[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, re.sub(r"\s*\[S\d{1,3}\]", "", answer[at:])])


def with_markers(answer: str, claims: Sequence[tuple[str, str]]) -> str:
    """An answer with a label put behind every claim that it has word for word (white space aside), longest first."""
    for claim, label in sorted(claims, key=lambda c: -len(c[0])):
        words = [re.escape(w) for w in claim.split()]
        if words:
            answer = re.sub(r"\s+".join(words), lambda m, label=label: f"{m[0]} [{label}]", answer, count=1)
    return answer


def context_levels(messages: DataFrame, group: str, order: Sequence[Column], text: Column, budget: int) -> DataFrame:
    """(group, level, messages, tokens): the first level of the ladder whose newest messages, each cut, fit the budget
    by the rule of 3.5 ASCII characters a token; the last level if none does.

    Levels look at the newest eight messages of a group, found without a window over the whole group: positions from
    the newest come from running counts over blocks.
    """
    numbered = scan_groups(messages.select(group, *[c for c in messages.columns if c != group]), [group], order, {"_newer": ("sum", F.lit(1))})
    newest = numbered.withColumn("_n", F.coalesce("_newer", F.lit(0)) + 1).filter(F.col("_n") <= LADDER[0][0])

    def tokens(most: int) -> Column:
        cut = T.shortened(F.coalesce(text, F.lit("")), most)
        ascii_ = F.length(F.regexp_replace(cut, r"[^\x{00}-\x{7F}]", ""))
        return F.ceil(ascii_ / 3.5 + (F.length(cut) - ascii_)).cast("bigint")

    sums = [F.sum(F.when(F.col("_n") <= n, tokens(c))).alias(f"_t{i}") for i, (n, c) in enumerate(LADDER)]
    counts = [F.count_if(F.col("_n") <= n).alias(f"_m{i}") for i, (n, _) in enumerate(LADDER)]
    out = newest.groupBy(group).agg(*sums, *counts)
    last = len(LADDER) - 1
    level = F.lit(last)
    for i in reversed(range(last)):
        level = F.when(F.col(f"_t{i}") <= budget, F.lit(i)).otherwise(level)
    pick = lambda p: F.element_at(F.array(*[F.col(f"{p}{i}") for i in range(len(LADDER))]), level + 1)
    return out.select(group, level.alias("level"), pick("_m").alias("messages"), pick("_t").alias("tokens"))


def family_members(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits on a lettered equation with its siblings (same number, other letter) at a score 0.01 lower, none twice:
    (need_id, label, score). ``labels`` has label; ``hits`` need_id, label and score."""
    base = lambda c: F.regexp_extract(c, r"^(\d+)[a-z]?$", 1)
    siblings = hits.select("need_id", base("label").alias("b"), (F.col("score") - 0.01).alias("score")).join(labels.select("label", base("label").alias("b")), "b").select("need_id", "label", "score")
    return hits.select("need_id", "label", "score").unionByName(siblings).groupBy("need_id", "label").agg(F.max("score").alias("score"))


def restricted(hits: DataFrame, need: str, wanted: Column) -> DataFrame:
    """Hits for which ``wanted`` holds, and all hits of needs for which it holds nowhere."""
    best = F.max(F.coalesce(wanted, F.lit(False))).over(Window.partitionBy(need))
    return hits.withColumn("_w", F.coalesce(wanted, F.lit(False))).withColumn("_any", best).filter(F.col("_w") | ~F.col("_any")).drop("_w", "_any")
