"""Three-vectors as column triples: plain arithmetic that stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> list[Column]:
    return [
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    ]


def sub(a, b) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def add(a, b) -> list[Column]:
    return [p + q for p, q in zip(a, b)]


def scale(a, s) -> list[Column]:
    return [p * s for p in a]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a, tiny: float = 1e-12) -> list[Column]:
    """Unit vector; a vector shorter than ``tiny`` is left as it is."""
    length = norm(a)
    safe = F.when(length < tiny, F.lit(1.0)).otherwise(length)
    return [p / safe for p in a]


def clip(c: Column, lo, hi) -> Column:
    """Clip to a range, keeping null (least and greatest would drop it)."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def cell(value: Column, origin, size) -> Column:
    """Index of the half-open cell a value falls in."""
    return F.floor((value - origin) / size)


def r6(c: Column) -> Column:
    """Round a measurement for reporting; adding zero turns minus zero into zero."""
    return F.round(c, 6) + F.lit(0.0)
