"""Boxes on a page, as columns x, y, w and h in parts of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import clamp

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns of a box, with a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")


def area(b: Box) -> Column:
    """Area; 0 for a degenerate box."""
    return F.greatest(b[2], F.lit(0.0)) * F.greatest(b[3], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    """Area that both cover."""
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def overlap(a: Box, b: Box) -> Column:
    """Common area in parts of the smaller box; 0 for degenerate ones."""
    return F.coalesce(intersection(a, b) / F.nullif(F.least(area(a), area(b)), F.lit(0.0)), F.lit(0.0))


def coverage(part: Box, whole: Box) -> Column:
    """Common area in parts of ``whole``."""
    return F.coalesce(intersection(part, whole) / F.nullif(area(whole), F.lit(0.0)), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union."""
    both = intersection(a, b)
    return F.coalesce(both / F.nullif(area(a) + area(b) - both, F.lit(0.0)), F.lit(0.0))


def valid(b: Box) -> Column:
    """Whether a box lies on the page and has an area; false for nulls."""
    edge = 1.000001
    ok = (b[0] >= 0) & (b[1] >= 0) & (b[2] > 0) & (b[3] > 0) & (b[0] + b[2] <= edge) & (b[1] + b[3] <= edge)
    return F.coalesce(ok & ~F.isnan(b[0]) & ~F.isnan(b[1]) & ~F.isnan(b[2]) & ~F.isnan(b[3]), F.lit(False))


def region_size(b: Box) -> Column:
    """Whether a region is neither too small nor too large to be one formula or figure."""
    return (b[2] >= 0.005) & (b[3] >= 0.003) & (area(b) <= 0.35) & (b[3] <= 0.60)


def lane(page: Column, b: Box) -> Column:
    """FULL, LEFT or RIGHT: wide boxes, and centred ones at the top of the first page, span the columns."""
    middle = b[0] + b[2] / 2
    full = (b[2] >= 0.55) | ((page == 1) & (b[1] < 0.32) & (F.abs(middle - 0.5) <= 0.14))
    return F.when(full, "FULL").when(middle < 0.5, "LEFT").otherwise("RIGHT")


def clipped(b: Box) -> Box:
    """The box cut to the page."""
    x, y = clamp(b[0]), clamp(b[1])
    return x, y, F.least(clamp(b[2]), 1 - x), F.least(clamp(b[3]), 1 - y)
