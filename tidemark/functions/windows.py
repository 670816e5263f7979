"""Trailing windows with a minimum of valid observations, and ANSI-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEY, ORDER = "symbol", "row_id"


def by_key():
    return Window.partitionBy(KEY).orderBy(ORDER)


def trailing(n: int, lag: int = 0):
    """The last ``n`` rows, ending ``lag`` rows ago."""
    return by_key().rowsBetween(-(n - 1) - lag, -lag)


def column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def over(aggregate, x, n: int, least: int | None = None, lag: int = 0) -> Column:
    """``aggregate`` over the trailing window; null until ``least`` values are valid."""
    x, w = column(x), trailing(n, lag)
    return F.when(F.count(x).over(w) >= (n if least is None else least), aggregate(x).over(w))


def safe_div(a, b) -> Column:
    return F.try_divide(column(a), F.nullif(column(b), F.lit(0.0)))


def shift(x, n: int = 1) -> Column:
    return F.lag(column(x), n).over(by_key())


def ahead(x, n: int) -> Column:
    return F.lead(column(x), n).over(by_key())


def zscore(x, n: int, least: int | None = None) -> Column:
    return safe_div(column(x) - over(F.avg, x, n, least), over(F.stddev_samp, x, n, least))


def percentile(q: float):
    return lambda x: F.percentile(x, F.lit(q))


def finite(x) -> Column:
    """NaN and infinities as null."""
    x = column(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
