"""Boxes as Column expressions: validity, overlap, relations and the relative geometry of two boxes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: keeps ratios of boxes finite.
EPSILON = 1e-8
#: Thresholds of the relations, and the least area of a source.
IN_SHARE, STANDING_GAP, ABOVE_GAP, LEAST_AREA = 0.8, 0.05, 0.1, 1e-9


@dataclass(frozen=True)
class Box:
    """A normalized box in four columns."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def named(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))

    @classmethod
    def of(cls, array: Column) -> Box:
        return cls(*(F.get(array, F.lit(i)) for i in range(4)))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    @property
    def area(self) -> Column:
        return self.width * self.height

    def clamped(self) -> Box:
        return Box(*(clamp(c) for c in (self.x1, self.y1, self.x2, self.y2)))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in ((self.x1, "x1"), (self.y1, "y1"), (self.x2, "x2"), (self.y2, "y2"))]


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, which ``least`` and ``greatest`` alone would pass over."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(F.greatest(F.lit(0.0), cx - w / 2), F.greatest(F.lit(0.0), cy - h / 2), F.least(F.lit(1.0), cx + w / 2), F.least(F.lit(1.0), cy + h / 2))


def is_valid_box(array: Column) -> Column:
    """Four values in [0, 1] that enclose an area; false for null, NaN and other sizes."""
    inside = F.forall(array, lambda v: F.coalesce(~F.isnan(v) & v.between(0.0, 1.0), F.lit(False)))
    b = Box.of(array)
    return F.coalesce((F.size(array) == 4) & inside & (b.x2 > b.x1) & (b.y2 > b.y1), F.lit(False))


def required_box(array: Column) -> Column:
    """The box itself; the query fails on one that isn't valid."""
    return F.when(is_valid_box(array), array).otherwise(F.raise_error(F.concat(F.lit("box must be four values in [0, 1] that enclose an area: "), F.coalesce(F.to_json(array), F.lit("null")))).cast("array<double>"))


def _overlap(a: Box, b: Box) -> tuple[Column, Column]:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)), F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def intersection(a: Box, b: Box) -> Column:
    x, y = _overlap(a, b)
    return x * y


def iou(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    area = lambda q: F.greatest(zero, q.width) * F.greatest(zero, q.height)
    common = intersection(a, b)
    return common / (area(a) + area(b) - common + F.lit(EPSILON))


def contains_centre(outer: Box, inner: Box) -> Column:
    """Whether the centre of ``inner`` lies in ``outer``, borders included."""
    return inner.cx.between(outer.x1, outer.x2) & inner.cy.between(outer.y1, outer.y2)


def centre_distance(a: Box, b: Box) -> Column:
    return F.hypot(a.cx - b.cx, a.cy - b.cy)


def edge_features(a: Box, b: Box) -> Column:
    """Ten values of b as seen from a: distance, offsets, direction, overlaps and log size ratios."""
    dx, dy = b.cx - a.cx, b.cy - a.cy
    # direction by the angle, so that equal centres point along x
    angle = F.atan2(dy, dx)
    eps, zero = F.lit(EPSILON), F.lit(0.0)
    area_a, area_b = F.greatest(zero, a.area), F.greatest(zero, b.area)
    smaller = F.least(area_a, area_b)
    ratio = lambda to, of: F.when(of > 0, F.log1p(to / (of + eps))).otherwise(zero)
    return F.array(F.hypot(dx, dy), dx, dy, F.sin(angle), F.cos(angle), iou(a, b), F.when(smaller > 0, intersection(a, b) / (smaller + eps)).otherwise(zero), ratio(area_b, area_a), ratio(b.width, a.width), ratio(b.height, a.height))


def relation_label(a: Box, b: Box) -> Column:
    """How a stands to b; the first rule that holds."""
    x, y = _overlap(a, b)
    common = x * y
    return (
        F.when(common / F.greatest(F.lit(LEAST_AREA), a.area) > IN_SHARE, "in")
        .when((x > 0) & (F.abs(a.y2 - b.y1) < STANDING_GAP), "standing on")
        .when(common > 0, "beside")
        .when(a.cy < b.cy - ABOVE_GAP, "above")
        .otherwise("next to")
    )


def pixel_bounds(b: Box, width: Column, height: Column) -> Box:
    """Whole pixels, halves to even, clipped to the frame; null where a coordinate or the size is null."""
    at = lambda v, n: F.when((v * n).isNotNull(), F.least(n, F.greatest(F.lit(0), F.bround(v * n).cast("int"))))
    return Box(at(b.x1, width), at(b.y1, height), at(b.x2, width), at(b.y2, height))


def from_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """A pixel box as corner and size, normalized and clipped."""
    return Box(clamp(x / width), clamp(y / height), clamp((x + w) / width), clamp((y + h) / height))


def from_polygon(points: Column, width: Column, height: Column) -> Box:
    """The extent of an array of [x, y] points, normalized and clipped."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return Box(clamp(F.array_min(xs) / width), clamp(F.array_min(ys) / height), clamp(F.array_max(xs) / width), clamp(F.array_max(ys) / height))


def from_grid(value: Column, size: Column, grid: int = 1000) -> Column:
    """A coordinate of a 0..grid answer in pixels, clipped to the frame; null for null."""
    at = value / F.lit(float(grid)) * size
    return F.when(at.isNotNull(), F.least(size.cast("double"), F.greatest(F.lit(0.0), at)))
