"""Window helpers: frames that hold a full count of values, as rolling statistics need them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def own(order: str = "date") -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(order)


def rolling(x: Column | str, n: int, fn: Callable[[Column], Column] = F.avg, least: int | None = None, lag: int = 0, order: str = "date") -> Column:
    """fn over the n rows that end lag rows back; null with fewer than `least` (n) values."""
    x = F.col(x) if isinstance(x, str) else x
    frame = own(order).rowsBetween(-(n - 1) - lag, -lag)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), fn(x).over(frame))


def shift(x: Column | str, n: int = 1, order: str = "date") -> Column:
    return (F.lag if n >= 0 else F.lead)(x, abs(n)).over(own(order))


def change(x: str, n: int, order: str = "date") -> Column:
    return F.try_divide(F.col(x), shift(x, n, order)) - 1


def run_length(flag: Column, order: str = "date", first: bool = True) -> Column:
    """Rows in a row, up to this one, for which flag holds. Without first, the first row never counts."""
    w = own(order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(flag, F.lit(False))
    if not first:
        held = held & (F.row_number().over(own(order)) > 1)
    at = F.row_number().over(own(order))
    return F.when(held, at - F.coalesce(F.last(F.when(~held, at), ignorenulls=True).over(w), F.lit(0))).otherwise(0)
