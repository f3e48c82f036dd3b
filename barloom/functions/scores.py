"""Column expressions for scores and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def tolerance(x: Column, most: float) -> Column:
    """1 at 0, falling to 0 at most."""
    return clamp(1 - F.abs(x) / most) if most > 0 else F.lit(0.0)


def ramp(x: Column, low: float, high: float) -> Column:
    """0 at low, rising to 1 at high."""
    return clamp((x - low) / (high - low)) if high > low else F.when(x >= high, 1.0).otherwise(0.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = F.try_divide(hits.cast("double"), n)
    below = 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (centre - half) / below), F.when(n > 0, (centre + half) / below)


def t_stat(x: Column, least: int = 3) -> Column:
    """Mean over its standard error, as an aggregate; null below `least` values and without spread."""
    return F.when((F.count(x) >= least) & (F.stddev_pop(x) > 0), F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * F.sqrt(F.count(x)))


def welch(a: Column, b: Column, least: int = 3) -> Column:
    """Welch's t of two conditional columns, as an aggregate."""
    error = F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    return F.when((F.count(a) >= least) & (F.count(b) >= least), F.try_divide(F.avg(a) - F.avg(b), error))


def profit_factor(r: Column) -> Column:
    return F.try_divide(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r)))


def conditional(label_of: list[tuple[str, Column]]) -> Column:
    """Labels of all groups that a row is in; groups may overlap. Explode it."""
    return F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in label_of]), lambda x: x.isNotNull())


def periods(date: Column, split: str) -> Column:
    return F.array(F.lit("all"), F.when(date < F.lit(split).cast("date"), "train").otherwise("test"))
