"""From positioned glyphs to lines of text: rows, columns, words. One task a document, which bounds the unit.

Input: doc_id, page, text (one glyph), x, y (of the baseline), w, h, in points. Order of input rows doesn't matter.
"""

from __future__ import annotations

from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Output of ``glyph_lines``.
LINES = "doc_id bigint, page int, row_no int, lane string, text string, x double, y double, w double, h double"


def rows_of(page: pd.DataFrame) -> list[pd.DataFrame]:
    """Glyphs in rows from the top: a glyph joins a row whose running median baseline is within 0.32 of the median
    height, at least 1.4 and at most 4.5."""
    if page.empty:
        return []
    near = min(4.5, max(1.4, 0.32 * float(page["h"].median())))
    groups: list[list[int]] = []
    lines: list[list[float]] = []
    for i, y in page.sort_values(["y", "x"])["y"].items():
        if lines and abs(y - median(lines[-1])) <= near:
            groups[-1].append(i)
            lines[-1].append(y)
        else:
            groups.append([i])
            lines.append([y])
    return [page.loc[g].sort_values("x") for g in groups]


def gutter_of(rows: list[pd.DataFrame], width: float) -> float | None:
    """The middle of the white band between two columns, or None: gaps near the centre, wide against the type, in at
    least four rows that agree within 0.03 of the width."""
    found = []
    for r in rows:
        right = (r["x"] + r["w"]).to_numpy()[:-1]
        left = r["x"].to_numpy()[1:]
        for a, b in zip(right, left):
            if b - a >= max(0.78 * float(r["h"].median()), 0.008 * width) and abs((a + b) / 2 - width / 2) <= 0.16 * width:
                found.append((a + b) / 2)
    best: list[float] = []
    for c in found:
        own = [x for x in found if abs(x - c) <= 0.03 * width]
        if len(own) > len(best):
            best = own
    return float(np.median(best)) if len(best) >= 4 else None


def agreed_gutter(pages: dict[int, float | None], width: float) -> dict[int, float | None]:
    """The gutter of each page: the document's median where two pages agree within 0.045 of the width and the page's
    own isn't more than 0.035 off; else the page's own."""
    known = [g for g in pages.values() if g is not None]
    if not known:
        return pages
    middle = float(np.median(known))
    close = [g for g in known if abs(g - middle) <= 0.045 * width]
    if len(close) < 2:
        return pages
    agreed = float(np.median(close))
    return {p: agreed if g is None or abs(g - agreed) <= 0.035 * width else g for p, g in pages.items()}


def words_of(row: pd.DataFrame) -> str:
    """The glyphs of a row as text: a space where the gap is over 0.28 of the median width, at least 0.7."""
    least = max(0.7, 0.28 * float(row["w"].median()))
    out, end = "", None
    for g in row.itertuples(index=False):
        if end is not None and g.x - end > least and not out.endswith(" ") and g.text != " ":
            out += " "
        out += g.text
        end = g.x + g.w
    return out.strip()


def split_row(row: pd.DataFrame, gutter: float | None) -> list[tuple[str, pd.DataFrame]]:
    """(lane, glyphs): a row parted at the gutter if no glyph crosses it and the gap there is wide, else FULL."""
    if gutter is None:
        return [("FULL", row)]
    left, right = row[row["x"] + row["w"] <= gutter + 1e-9], row[row["x"] >= gutter - 1e-9]
    if len(left) + len(right) < len(row):
        return [("FULL", row)]
    if left.empty or right.empty:
        return [("LEFT", left)] if right.empty else [("RIGHT", right)]
    gap = float(right["x"].min() - (left["x"] + left["w"]).max())
    return [("LEFT", left), ("RIGHT", right)] if gap >= 0.78 * float(row["h"].median()) else [("FULL", row)]


def glyph_lines(glyphs: DataFrame, width: float = 612.0) -> DataFrame:
    """The lines of every document, in ``LINES``: rows from the top of each page, parted at the gutter. Glyphs without
    text or position are left out; a document without glyphs gives no row."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = {int(p): rows_of(g) for p, g in pdf.dropna(subset=["page", "x", "y", "w", "h", "text"]).groupby("page")}
        gutters = agreed_gutter({p: gutter_of(r, width) for p, r in pages.items()}, width)
        out = []
        for p in sorted(pages):
            for no, row in enumerate(pages[p]):
                for lane, part in split_row(row, gutters[p]):
                    text = words_of(part)
                    if text:
                        x, y = float(part["x"].min()), float(part["y"].min())
                        out.append((int(pdf["doc_id"].iloc[0]), p, no, lane, text, x, y, float((part["x"] + part["w"]).max()) - x, float(part["h"].max())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    return glyphs.select("doc_id", "page", "text", "x", "y", "w", "h").groupBy("doc_id").applyInPandas(fold, LINES)
