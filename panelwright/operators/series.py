"""Monthly series operators.

All windows here run over one series of calendar months (one row per month, gaps filled
by :func:`panelwright.operators.calendar.month_spine`), so their size is bounded by the
calendar whatever the size of the raw data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelwright.functions.cleaning import safe_log

TRANSFORMS = ("level", "diff", "pct", "yoy_pct", "logdiff_ann")


def transformed(value: str, window: Window, kind: str) -> Column:
    """Transform of a level series; nothing looks past the row's own month.

    Division by zero and logarithms of values that have none give NULL.
    """
    now = F.col(value)
    if kind == "level":
        return now.cast("double")
    if kind == "diff":
        return now - F.lag(value, 1).over(window)
    if kind == "pct":
        return (F.try_divide(now, F.lag(value, 1).over(window)) - 1.0) * 100.0
    if kind == "yoy_pct":
        return (F.try_divide(now, F.lag(value, 12).over(window)) - 1.0) * 100.0
    if kind == "logdiff_ann":
        return (safe_log(now) - safe_log(F.lag(value, 1).over(window))) * 1200.0
    raise ValueError(f"unknown transform {kind!r}, expected one of {TRANSFORMS}")


def transform_series(
    df: DataFrame, keys: list[str], order: str, value: str, kinds: dict[str, str], name_column: str, out: str
) -> DataFrame:
    """Adds ``out``: each series, told by ``name_column``, in its own transform. Other names give NULL."""
    window = Window.partitionBy(*keys).orderBy(order)
    choice = F
    for series, kind in kinds.items():
        choice = choice.when(F.col(name_column) == series, transformed(value, window, kind))
    return df.withColumn(out, choice.otherwise(F.lit(None).cast("double")))


def ffill_limit(value: str, window: Window, limit: int) -> Column:
    """Last known value, at most ``limit`` months old."""
    return F.last(value, ignorenulls=True).over(window.rowsBetween(-limit, 0))


def rolling_sd(value: str, window: Window, length: int, min_periods: int) -> Column:
    frame = window.rowsBetween(-(length - 1), 0)
    return F.when(F.count(value).over(frame) >= min_periods, F.stddev_samp(value).over(frame))


def lags(value: str, window: Window, first: int, last: int) -> list[Column]:
    """``value`` lagged by ``first`` to ``last`` months."""
    return [F.lag(value, k).over(window) if k else F.col(value) for k in range(first, last + 1)]


def label(value: str, window: Window, horizon: int) -> Column:
    """The value ``horizon`` months ahead. Values past the last known month are NULL, so a label
    exists only once it has matured."""
    return F.lead(value, horizon).over(window)
