"""Window columns over ordered bars of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEY, ORDER = "symbol", "opened_at"


def by_time(key: str = KEY, order: str = ORDER):
    return Window.partitionBy(key).orderBy(order)


def full(fn: Column, w: int, column: str = "close") -> Column:
    """A rolling value over the last ``w`` rows, null until that many values exist."""
    frame = by_time().rowsBetween(1 - w, 0)
    return F.when(F.count(column).over(frame) == w, fn.over(frame))


def prior(fn: Column, w: int, own: Column) -> Column:
    """A value over the previous ``w`` rows without the current one; ``own`` when there are none."""
    return F.coalesce(fn.over(by_time().rowsBetween(-w, -1)), own)


def prior_full(fn: Column, w: int, skip: int = 0) -> Column:
    """As ``prior``, ``skip`` rows further back, null until ``w`` rows exist."""
    frame = by_time().rowsBetween(-w - skip, -1 - skip)
    return F.when(F.count(F.lit(1)).over(frame) == w, fn.over(frame))


def shift(column: str, n: int) -> Column:
    return F.lag(column, n).over(by_time())


def change_if_step(column: str, ts: str, seconds: int, relative: bool = False) -> Column:
    """Change to the previous row, only where that is exactly ``seconds`` old."""
    old, at = F.lag(column).over(by_time(order=ts)), F.lag(ts).over(by_time(order=ts))
    exact = F.unix_timestamp(ts) - F.unix_timestamp(at) == seconds
    value = F.try_divide(F.col(column) - old, old) if relative else F.col(column) - old
    return F.when(exact, value)


def running(fn: Column) -> Column:
    return fn.over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def true_range() -> Column:
    """High minus low of the first bar, else also the distances to the previous close."""
    before = F.lag("close").over(by_time())
    span = F.col("high") - F.col("low")
    return F.when(before.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def recent_any(cond: Column, rows: int) -> Column:
    return F.max(F.coalesce(cond, F.lit(False))).over(by_time().rowsBetween(1 - rows, 0))
