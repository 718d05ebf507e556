"""Geometry of boxes and polygons as Spark column expressions.

A box is ``Box(x1, y1, x2, y2)`` of double columns; a polygon is an array of
``struct<x, y>``. Everything stays in whole-stage code generation. Coordinates
are doubles throughout, and every ratio is guarded, as ANSI mode raises on a
zero divisor. Ratios that differ in their divisor have separate names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        """The box of columns ``<prefix>x1`` to ``<prefix>y2``; a prefix may end in a dot."""
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @classmethod
    def at(cls, struct: Column) -> "Box":
        return cls(*(struct[c] for c in ("x1", "y1", "x2", "y2")))

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(self, ("x1", "y1", "x2", "y2"))))

    def select(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self, ("x1", "y1", "x2", "y2"))]



def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def box_area(b: Box) -> Column:
    """Width x height, not below 0 (``calculate_bbox_area``)."""
    return F.greatest(width(b) * height(b), F.lit(0.0))


def box_center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0


def min_side(b: Box) -> Column:
    return F.least(width(b), height(b))


def long_side(b: Box) -> Column:
    return F.greatest(width(b), height(b))


def overlap_width(a: Box, b: Box) -> Column:
    return F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)


def overlap_height(a: Box, b: Box) -> Column:
    return F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)


def intersection_area(a: Box, b: Box) -> Column:
    return F.greatest(overlap_width(a, b), F.lit(0.0)) * F.greatest(overlap_height(a, b), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union."""
    both = intersection_area(a, b)
    return _ratio(both, width(a) * height(a) + width(b) * height(b) - both)


def iou_inclusive(a: Box, b: Box) -> Column:
    """IoU of boxes whose sides count their end pixels: every side one longer."""
    w = F.greatest(overlap_width(a, b) + 1.0, F.lit(0.0))
    h = F.greatest(overlap_height(a, b) + 1.0, F.lit(0.0))
    both = w * h
    return _ratio(both, (width(a) + 1) * (height(a) + 1) + (width(b) + 1) * (height(b) + 1) - both)


def ioa(a: Box, b: Box) -> Column:
    """Intersection over the area of ``a``."""
    return _ratio(intersection_area(a, b), width(a) * height(a))


def overlap_over_second(a: Box, b: Box) -> Column:
    """Intersection over the area of ``b``: a cell's covered share."""
    return ioa(b, a)


def ioa_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return _ratio(intersection_area(a, b), F.least(width(a) * height(a), width(b) * height(b)))


def overlap_ratio(a: Box, b: Box, mode: str = "union") -> Column:
    """Intersection over the union, the smaller (``small``) or the larger (``large``) area."""
    both, one, two = intersection_area(a, b), box_area(a), box_area(b)
    base = {"union": one + two - both, "small": F.least(one, two), "large": F.greatest(one, two)}[mode]
    return _ratio(both, base)


def axis_overlap_ratio(a: Box, b: Box, axis: str = "x", mode: str = "union") -> Column:
    """One-dimensional overlap along ``x`` or ``y`` over the union, smaller or larger extent."""
    a1, a2, b1, b2 = (a.x1, a.x2, b.x1, b.x2) if axis == "x" else (a.y1, a.y2, b.y1, b.y2)
    both = F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0.0))
    base = {"union": F.greatest(a2, b2) - F.least(a1, b1), "small": F.least(a2 - a1, b2 - b1), "large": F.greatest(a2 - a1, b2 - b1)}[mode]
    return _ratio(both, base)


def is_fully_inside(a: Box, container: Box, tolerance: float = 0.0) -> Column:
    return (a.x1 + tolerance >= container.x1) & (a.y1 + tolerance >= container.y1) & (a.x2 - tolerance <= container.x2) & (a.y2 - tolerance <= container.y2)


def overlaps(a: Box, b: Box, more_than: float | Column = 0.0) -> Column:
    """Both overlap sides exceed a number of pixels."""
    return (overlap_width(a, b) > more_than) & (overlap_height(a, b) > more_than)


def is_contained(inner: Box, outer: Box, share: float = 0.9) -> Column:
    """At least ``share`` of the inner box lies in the outer one; an empty inner box never does."""
    return (width(inner) * height(inner) > 0) & (ioa(inner, outer) >= share)


def union_box(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def intersection_box(a: Box, b: Box, more_than: float = 1.0) -> Column:
    """The common box as a struct, null if either side is at most ``more_than``."""
    c = Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))
    return F.when((width(c) > more_than) & (height(c) > more_than), c.struct())


def merge_box(a: Box, b: Box, mode: Column) -> Column:
    """Struct of the larger (``large``), smaller (``small``) or enclosing (``union``) box; the first wins equal areas."""
    one, two = box_area(a), box_area(b)
    return F.when(mode == "large", F.when(one >= two, a.struct()).otherwise(b.struct())).when(mode == "small", F.when(one <= two, a.struct()).otherwise(b.struct())).otherwise(union_box(a, b).struct())


def translate(b: Box, dx: Column | float, dy: Column | float) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def scale_about_center(b: Box, w_ratio: Column | float, h_ratio: Column | float) -> Box:
    """The box resized about its centre (``unclip_boxes``)."""
    cx, cy = box_center(b)
    w, h = width(b) * w_ratio / 2.0, height(b) * h_ratio / 2.0
    return Box(cx - w, cy - h, cx + w, cy + h)


def clamp(b: Box, page_w: Column, page_h: Column) -> Box:
    c = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    return Box(c(b.x1, page_w), c(b.y1, page_h), c(b.x2, page_w), c(b.y2, page_h))


def pad(b: Box, page_w: Column, page_h: Column, ratio: float) -> Box:
    """Grown on every side by a share of its sides (of at least a pixel), kept on the page."""
    px, py = F.greatest(width(b), F.lit(1.0)) * ratio, F.greatest(height(b), F.lit(1.0)) * ratio
    return Box(F.greatest(b.x1 - px, F.lit(0.0)), F.greatest(b.y1 - py, F.lit(0.0)), F.least(b.x2 + px, page_w), F.least(b.y2 + py, page_h))


def to_page(b: Box, page_w: Column, page_h: Column) -> Box:
    """Detector coordinates on the page: clamped shares if they look like shares, else clamped pixels."""
    unit = (b.x2 <= 1.05) & (b.y2 <= 1.05) & (b.x1 >= -0.05) & (b.y1 >= -0.05) & (page_w > 0) & (page_h > 0)
    c = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    s = lambda v, by: F.when(unit, c(v, F.lit(1.0)) * by).otherwise(c(v, by))
    return Box(s(b.x1, page_w), s(b.y1, page_h), s(b.x2, page_w), s(b.y2, page_h))


def normalise(b: Box, page_w: Column, page_h: Column) -> Column:
    """[x1, y1, x2, y2] in shares of the page, within 0 and 1."""
    u = lambda v, by: F.least(F.greatest(F.when(by > 0, v / by).otherwise(0.0), F.lit(0.0)), F.lit(1.0))
    return F.array(u(b.x1, page_w), u(b.y1, page_h), u(b.x2, page_w), u(b.y2, page_h))


def normalise_thousandths(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Struct of thousandths as shares, swapped into order; null outside 0..1000 or without extent."""
    b = Box(F.least(x1, x2) / 1000.0, F.least(y1, y2) / 1000.0, F.greatest(x1, x2) / 1000.0, F.greatest(y1, y2) / 1000.0)
    inside = (F.least(x1, y1, x2, y2) >= 0) & (F.greatest(x1, y1, x2, y2) <= 1000)
    return F.when(inside & (x1 != x2) & (y1 != y2), b.struct())


def is_valid(b: Box) -> Column:
    """Positive extent and finite coordinates."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return (b.x2 > b.x1) & (b.y2 > b.y1) & finite(b.x1) & finite(b.y1) & finite(b.x2) & finite(b.y2)


def l1_distance(a: Box, b: Box) -> Column:
    """Sum of the four corner differences."""
    return sum((F.abs(p - q) for p, q in zip(a[1:], b[1:])), F.abs(a.x1 - b.x1))


def corner_distance(table: Box, ocr: Box) -> Column:
    """The L1 distance plus the smaller of its top-left and bottom-right parts."""
    top = F.abs(ocr.x1 - table.x1) + F.abs(ocr.y1 - table.y1)
    bottom = F.abs(ocr.x2 - table.x2) + F.abs(ocr.y2 - table.y2)
    return top + bottom + F.least(top, bottom)


def nearest_edge_distance(a: Box, b: Box, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> Column:
    """Weighted gap between two boxes: left, right, up, down weights; 0 where both axes overlap."""
    h, v = axis_overlap_ratio(a, b, "x"), axis_overlap_ratio(a, b, "y")
    gap = lambda lo1, hi1, lo2, hi2, wa, wb: F.least(F.abs(lo1 - hi2), F.abs(hi1 - lo2)) * F.when(hi1 < lo2, wa).otherwise(wb)
    dx = F.when(h == 0, gap(a.x1, a.x2, b.x1, b.x2, weights[0], weights[1])).otherwise(0.0)
    dy = F.when(v == 0, gap(a.y1, a.y2, b.y1, b.y2, weights[2], weights[3])).otherwise(0.0)
    return F.when((h > 0) & (v > 0), 0.0).otherwise(dx + dy)


def same_line(a: Box, b: Box) -> Column:
    """Vertical overlap above half of the smaller height; never for a flat box."""
    low = F.least(height(a), height(b))
    return (low > 0) & (F.greatest(overlap_height(a, b), F.lit(0.0)) > 0.5 * low)


def same_text_line(a: Box, b: Box, share: float = 0.6, y_tolerance: float = 10.0) -> Column:
    """Vertical overlap of at least ``share`` of the smaller height (a pixel at least), or centres close in y."""
    low = F.least(F.greatest(height(a), F.lit(1.0)), F.greatest(height(b), F.lit(1.0)))
    gap = F.abs(box_center(a)[1] - box_center(b)[1])
    return (F.greatest(overlap_height(a, b), F.lit(0.0)) / low >= share) | (gap <= F.greatest(0.5 * low, F.lit(1.0), F.lit(0.25 * y_tolerance)))


def alignment(cur: Box, prev: Box, within: float = 5.0) -> Column:
    return F.when(F.abs(cur.x1 - prev.x1) <= within, "left").when(F.abs(cur.x2 - prev.x2) <= within, "right").otherwise("center")


def rotate_back(x: Column, y: Column, angle: Column, rotated_w: Column, rotated_h: Column) -> tuple[Column, Column]:
    """A point of a page turned by 90, 180 or 270 degrees on the page as it was; other angles leave it."""
    deg = F.pmod(F.round(angle).cast("int"), F.lit(360))
    nx = F.when(deg == 90, rotated_h - y).when(deg == 180, rotated_w - x).when(deg == 270, y).otherwise(x)
    ny = F.when(deg == 90, x).when(deg == 180, rotated_h - y).when(deg == 270, rotated_w - x).otherwise(y)
    return nx, ny


# -- polygons: array<struct<x double, y double>>


def poly_of(b: Box) -> Column:
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(b.x1, b.y1), p(b.x2, b.y1), p(b.x2, b.y2), p(b.x1, b.y2))


def _closed(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def poly_area(points: Column) -> Column:
    """Shoelace area, 0 below three points."""
    twice = F.aggregate(F.zip_with(points, _closed(points), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(points) >= 3, F.abs(twice) / 2.0).otherwise(0.0)


def poly_perimeter(points: Column) -> Column:
    """Length of the closed outline."""
    step = F.zip_with(points, _closed(points), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    return F.aggregate(step, F.lit(0.0), lambda s, v: s + v)


def poly_box(points: Column) -> Box:
    """Bounds of a polygon; zeros when it is empty."""
    lo = lambda c: F.coalesce(F.array_min(F.transform(points, lambda p: p[c])), F.lit(0.0))
    hi = lambda c: F.coalesce(F.array_max(F.transform(points, lambda p: p[c])), F.lit(0.0))
    return Box(lo("x"), lo("y"), hi("x"), hi("y"))


def poly_center(points: Column) -> tuple[Column, Column]:
    """Mean of the vertices; zeros when empty."""
    mean = lambda c: F.when(F.size(points) > 0, F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / F.size(points)).otherwise(0.0)
    return mean("x"), mean("y")


def poly_translate(points: Column, dx: Column | float, dy: Column | float) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def poly_rotate_back(points: Column, angle: Column, rotated_w: Column, rotated_h: Column) -> Column:
    def one(p: Column) -> Column:
        x, y = rotate_back(p["x"], p["y"], angle, rotated_w, rotated_h)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, one)


def rect_corners(cx: Column, cy: Column, w: Column, h: Column, angle_degrees: Column) -> Column:
    """The four corners of a rotated rectangle."""
    a = angle_degrees * (math.pi / 180.0)
    cos, sin = F.cos(a), F.sin(a)
    p = lambda dx, dy: F.struct((cx + dx * cos - dy * sin).alias("x"), (cy + dx * sin + dy * cos).alias("y"))
    return F.array(p(-w / 2, -h / 2), p(w / 2, -h / 2), p(w / 2, h / 2), p(-w / 2, h / 2))


def box_from_coords(coords: Column) -> Column:
    """Struct of bounds of eight polygon numbers or of four box numbers; zeros otherwise."""
    every = lambda off: F.filter(F.transform(coords, lambda v, i: F.when(i % 2 == off, v)), lambda v: v.isNotNull())
    b8 = Box(F.array_min(every(0)), F.array_min(every(1)), F.array_max(every(0)), F.array_max(every(1)))
    b4 = Box(*(F.try_element_at(coords, F.lit(i)) for i in range(1, 5)))
    zero = Box(*([F.lit(0.0)] * 4))
    return F.when(F.size(coords) >= 8, b8.struct()).when(F.size(coords) >= 4, b4.struct()).otherwise(zero.struct())


def scale_coords(coords: Column, by: Column) -> Column:
    return F.transform(coords, lambda v: v * by)


def clamp_coords(coords: Column, low: float, high: float) -> Column:
    return F.transform(coords, lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))
