"""Plane geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction in degrees, (-180, 180]."""
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def polar(x: Column, y: Column, distance: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return x + distance * F.cos(a), y + distance * F.sin(a)


def within_frame(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Inclusive on all sides."""
    return x.between(x0, x1) & y.between(y0, y1)


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def orient(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column, how: str) -> tuple[Column, Column]:
    """A point turned inside its own bounding box."""
    dx, dy = x - x0, y - y0
    w, h = x1 - x0, y1 - y0
    turned = {"none": (dx, dy), "rot90": (h - dy, dx), "rot180": (w - dx, h - dy), "rot270": (dy, w - dx), "transpose": (dy, dx)}
    if how not in turned:
        raise ValueError(f"unknown orientation {how!r}; one of {sorted(turned)}")
    a, b = turned[how]
    return x0 + a, y0 + b


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """-1, 0 or 1: the side of ab on which c lies."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_intersect(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Do segments p = (x1, y1, x2, y2) and q meet, touching and collinear overlap included?"""
    ax, ay, bx, by = p
    cx, cy, dx, dy = q
    o1, o2 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy)
    o3, o4 = turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    on = lambda x1, y1, x2, y2, x, y: x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    return (
        ((o1 != o2) & (o3 != o4))
        | ((o1 == 0) & on(ax, ay, bx, by, cx, cy))
        | ((o2 == 0) & on(ax, ay, bx, by, dx, dy))
        | ((o3 == 0) & on(cx, cy, dx, dy, ax, ay))
        | ((o4 == 0) & on(cx, cy, dx, dy, bx, by))
    )
