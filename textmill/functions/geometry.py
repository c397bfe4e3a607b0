"""Rectangles as arrays (x0, y0, x1, y1) of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.config import Settings


def rect(value: Column) -> Column:
    return F.transform(value, lambda x: x.cast("double"))


def rect_key(value: Column) -> Column:
    """Key for equality of rectangles: coordinates to 4 decimals, ties to even."""
    return F.transform(value, lambda x: F.bround(x.cast("double"), 4))


def width(r: Column) -> Column:
    return F.greatest(r[2] - r[0], F.lit(0.0))


def height(r: Column) -> Column:
    return F.greatest(r[3] - r[1], F.lit(0.0))


def area(r: Column) -> Column:
    return width(r) * height(r)


def centre(r: Column) -> tuple[Column, Column]:
    return (r[0] + r[2]) / 2, (r[1] + r[3]) / 2


def inside(x: Column, y: Column, r: Column, slack: float = 1.0) -> Column:
    return x.between(r[0] - slack, r[2] + slack) & y.between(r[1] - slack, r[3] + slack)


def overlap_match(a: Column, b: Column) -> Column:
    """Whether the overlap is a quarter of the smaller area, or ``a``'s centre is in ``b``."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    smaller = F.least(area(a), area(b))
    return ((smaller > 0) & (w * h / F.when(smaller > 0, smaller) >= 0.25)) | inside(*centre(a), b)


def inner_cell(r: Column) -> Column:
    """A cell's rectangle less padding of 2 by 1, never below 1 of content."""
    px = F.least(F.lit(2.0), F.greatest((r[2] - r[0] - 1) / 2, F.lit(0.0)))
    py = F.least(F.lit(1.0), F.greatest((r[3] - r[1] - 1) / 2, F.lit(0.0)))
    return F.array(r[0] + px, r[1] + py, r[2] - px, r[3] - py)


def union_of(rects: Column) -> Column:
    """Bounding rectangle of an array of rectangles."""
    return F.array(*[f(_at(rects, i)) for i, f in enumerate((F.array_min, F.array_min, F.array_max, F.array_max))])


def _at(rects: Column, i: int) -> Column:
    return F.transform(rects, lambda r: r[i])


def union_agg(r: str) -> Column:
    """The same as an aggregate over rows."""
    c = F.col(r)
    return F.array(F.min(c[0]), F.min(c[1]), F.max(c[2]), F.max(c[3]))


def page_text_box(r: str, page: Column) -> Column:
    """Bounding rectangle of a page's text with a margin of 2, within the page; the page if it has none."""
    box = union_agg(r)
    grown = F.array(F.greatest(page[0], box[0] - 2), F.greatest(page[1], box[1] - 2), F.least(page[2], box[2] + 2), F.least(page[3], box[3] + 2))
    return F.when(box[0].isNotNull(), grown).otherwise(page)


def role_min_size(kind: Column, s: Settings = Settings()) -> Column:
    return F.when(kind == "cell", s.table_min).when(kind.isin("caption_fig", "caption_tab"), s.caption_min).when(kind == "heading", s.heading_min).otherwise(s.body_min)


def pixel_rect(bbox: Column, w: Column, h: Column) -> Column:
    """A box in thousandths as pixels, outwards; null if empty."""

    def clip(x: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(most, x)).cast("int")

    x0, y0 = clip(F.floor(bbox[0] * w / 1000.0), w), clip(F.floor(bbox[1] * h / 1000.0), h)
    x1, y1 = clip(F.ceil(bbox[2] * w / 1000.0), w), clip(F.ceil(bbox[3] * h / 1000.0), h)
    return F.when((x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


def expanded_rect(r: Column, w: Column, h: Column, padding: int, ratio: float = 0.04) -> Column:
    ratio = max(0.0, min(ratio, 0.25))
    px = F.greatest(F.lit(padding), F.bround((r[2] - r[0]) * F.lit(ratio)).cast("int"))
    py = F.greatest(F.lit(padding), F.bround((r[3] - r[1]) * F.lit(ratio)).cast("int"))
    return F.array(F.greatest(F.lit(0), r[0] - px), F.greatest(F.lit(0), r[1] - py), F.least(w, r[2] + px), F.least(h, r[3] + py))


def rgb(color: Column) -> Column:
    """A packed colour as parts from 0 to 1."""
    return F.array(*[F.shiftright(color, n).bitwiseAND(0xFF) / 255.0 for n in (16, 8, 0)])


def foreground(background: Column) -> Column:
    """Black on light backgrounds, else white."""
    light = background[0] * 0.2126 + background[1] * 0.7152 + background[2] * 0.0722
    return F.when(light >= 145, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array(F.lit(255), F.lit(255), F.lit(255)))
