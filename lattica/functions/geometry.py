"""Rectangles, boxes and points as Catalyst expressions. A rectangle is four columns min_y, min_x, max_y, max_x behind a prefix."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("min_y", "min_x", "max_y", "max_x")


class Rect:
    """Column expressions of a rectangle, (y, x) order."""

    def __init__(self, min_y: Column, min_x: Column, max_y: Column, max_x: Column) -> None:
        self.min_y, self.min_x, self.max_y, self.max_x = min_y, min_x, max_y, max_x

    @classmethod
    def of(cls, prefix: str = "", alias: str = "") -> Rect:
        dot = f"{alias}." if alias else ""
        return cls(*[F.col(f"{dot}{prefix}{s}") for s in SIDES])

    @classmethod
    def from_corner(cls, y: Column, x: Column, h: Column, w: Column) -> Rect:
        return cls(y, x, y + h, x + w)

    @classmethod
    def from_center(cls, y: Column, x: Column, h: Column, w: Column) -> Rect:
        return cls(y - h / 2, x - w / 2, y + h / 2, x + w / 2)

    height = property(lambda s: s.max_y - s.min_y)
    width = property(lambda s: s.max_x - s.min_x)
    area = property(lambda s: (s.max_y - s.min_y) * (s.max_x - s.min_x))
    center_y = property(lambda s: s.min_y + (s.max_y - s.min_y) / 2)
    center_x = property(lambda s: s.min_x + (s.max_x - s.min_x) / 2)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + s) for c, s in zip((self.min_y, self.min_x, self.max_y, self.max_x), SIDES, strict=True)]

    def valid(self) -> Column:
        return (self.min_y < self.max_y) & (self.min_x < self.max_x)

    def intersects(self, o: Rect) -> Column:
        """Open intervals: rectangles that only touch do not intersect."""
        return (self.max_x > o.min_x) & (self.min_x < o.max_x) & (self.max_y > o.min_y) & (self.min_y < o.max_y)

    def union(self, o: Rect) -> Rect:
        return Rect(F.least(self.min_y, o.min_y), F.least(self.min_x, o.min_x), F.greatest(self.max_y, o.max_y), F.greatest(self.max_x, o.max_x))

    def clip(self, o: Rect) -> Rect:
        """Common part; meaningful only where ``intersects``."""
        return Rect(F.greatest(self.min_y, o.min_y), F.greatest(self.min_x, o.min_x), F.least(self.max_y, o.max_y), F.least(self.max_x, o.max_x))

    def overlap(self, o: Rect) -> Column:
        """Share of this rectangle's area that ``o`` covers, 0 where they are disjoint."""
        return F.when(self.intersects(o), F.try_divide(self.clip(o).area, self.area)).otherwise(0.0)

    def overlap_normalized(self, o: Rect) -> Column:
        """Common area relative to the largest that rectangles of these sizes can have in common."""
        return F.when(self.intersects(o), F.try_divide(self.clip(o).area, F.least(self.height, o.height) * F.least(self.width, o.width))).otherwise(0.0)

    def translate(self, dy: Column, dx: Column) -> Rect:
        return Rect(self.min_y + dy, self.min_x + dx, self.max_y + dy, self.max_x + dx)

    def scale_on_center(self, k: Column) -> Rect:
        return Rect.from_center(self.center_y, self.center_x, self.height * k, self.width * k)

    def scale_on_origin(self, k: Column) -> Rect:
        return Rect(self.min_y * k, self.min_x * k, self.max_y * k, self.max_x * k)

    def with_size(self, h: Column, w: Column) -> Rect:
        return Rect.from_center(self.center_y, self.center_x, h, w)

    def safe_round(self) -> Rect:
        """Whole bounds that lose nothing of the size: the lower corner is floored, the size raised."""
        y, x = F.floor(self.min_y).cast("double"), F.floor(self.min_x).cast("double")
        return Rect(y, x, y + F.ceil(self.height), x + F.ceil(self.width))


def contains_point(r: Rect, y: Column, x: Column) -> Column:
    """Closed containment."""
    return y.between(r.min_y, r.max_y) & x.between(r.min_x, r.max_x)


def boxes_touch(a: list[Column], b: list[Column]) -> Column:
    """Whether 3-D boxes (min_z, min_y, min_x, max_z, max_y, max_x) meet; closed, unlike rectangles."""
    out = F.lit(True)
    for k in range(3):
        out = out & (a[k + 3] >= b[k]) & (a[k] <= b[k + 3])
    return out


def rotate(y: Column, x: Column, angle: Column) -> tuple[Column, Column]:
    """Rotation of (y, x): the matrix turns y into x."""
    c, s = F.cos(angle), F.sin(angle)
    return c * y - s * x, s * y + c * x


def similarity(y: Column, x: Column, angle: Column, scale: Column, cy: Column, cx: Column, dy: Column, dx: Column) -> tuple[Column, Column]:
    """Source to target: rotated and scaled about the centre, then shifted."""
    ry, rx = rotate(y - cy, x - cx, angle)
    return scale * ry + cy + dy, scale * rx + cx + dx


def similarity_inverse(y: Column, x: Column, angle: Column, scale: Column, cy: Column, cx: Column, dy: Column, dx: Column) -> tuple[Column, Column]:
    ry, rx = rotate(F.try_divide(y - dy - cy, scale), F.try_divide(x - dx - cx, scale), -angle)
    return ry + cy, rx + cx


def arc_angle(oy: Column, ox: Column, ay: Column, ax: Column, by: Column, bx: Column) -> Column:
    """Angle from A to B about an origin, wrapped once into [-pi, pi]."""
    d = F.atan2(by - oy + 0.0, bx - ox + 0.0) - F.atan2(ay - oy + 0.0, ax - ox + 0.0)
    return F.when(d < -math.pi, d + 2 * math.pi).when(d > math.pi, d - 2 * math.pi).otherwise(d)


def nearest_power_of_two(v: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(v)))


def dimension_with_overlap(v: Column, overlap: Column) -> Column:
    """Size that a dimension is padded to for a least overlap; from one half on no padding is needed."""
    return F.when(overlap >= 0.5, v).otherwise(v + v * (1 - (overlap + 0.5)) * 2)


def shortest_decimal(v: Column, digits: int) -> Column:
    """Decimal text with at most ``digits`` places, without trailing zeros or point."""
    text = F.format_string(f"%.{digits}f", v)
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
