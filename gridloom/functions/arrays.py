"""Arrays of numbers over a grid, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resized(a: Column, size: Column | int) -> Column:
    """Cut to ``size`` entries, or filled up with zeros."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), n)), F.lit(1), n)


def rolled(a: Column, by: Column | int) -> Column:
    """Entries moved on by ``by`` places, those beyond the end to the beginning."""
    k = F.pmod(F.lit(by) if isinstance(by, int) else by, F.greatest(F.size(a), F.lit(1)))
    return F.when(F.size(a) == 0, a).otherwise(F.concat(F.slice(a, F.size(a) - k + 1, k), F.slice(a, F.lit(1), F.size(a) - k)))


def linspace(low: Column, high: Column, n: int) -> Column:
    """``n`` values from ``low`` to ``high`` at equal distances; of one, ``low``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / F.lit(max(n - 1, 1)))


def logspace(low: Column, high: Column, n: int) -> Column:
    """``n`` values from ``low`` to ``high``, both positive, at equal ratios."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low * F.pow(high / low, i / F.lit(float(max(n - 1, 1)))))


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """The value at ``x`` between the points of the rising ``xs`` and ``ys``; beyond the ends that of the end, null without points."""
    after = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1, y0, y1 = F.get(xs, after - 1), F.get(xs, after), F.get(ys, after - 1), F.get(ys, after)
    return F.when(after == 0, F.get(ys, F.lit(0))).when(after >= F.size(xs), F.get(ys, F.size(xs) - 1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
