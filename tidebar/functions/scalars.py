"""Scalar expressions with the engine's rules for missing values.

Missing is always NULL. A division by zero gives NULL, a comparison with NULL gives
a flag of 0, and clipping keeps NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def div(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(x: ColumnOrName, low: float, high: float) -> Column:
    x = c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def finite(x: ColumnOrName) -> Column:
    """NULL for NaN and for both infinities."""
    x = c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def opposite(a: Column, b: Column) -> Column:
    """1 where the two values have opposite signs, else 0 (also when one is missing)."""
    return flag(((a > 0) & (b < 0)) | ((a < 0) & (b > 0)))


def cyclic(x: ColumnOrName, period: int) -> tuple[Column, Column]:
    angle = c(x) * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def rounded(x: ColumnOrName, digits: int) -> Column:
    """Rounded, with minus zero turned into zero."""
    return F.round(c(x), digits) + F.lit(0.0)


def quality_band(percent_error: ColumnOrName) -> Column:
    pe = c(percent_error)
    return (
        F.when(pe <= 2.0, "excellent").when(pe <= 5.0, "good").when(pe <= 10.0, "fair").otherwise("poor")
    )


def stars(confidence: ColumnOrName, mark: str = "*") -> Column:
    """One mark per fifth of confidence; empty without a confidence."""
    n = F.floor(F.coalesce(c(confidence), F.lit(0.0)) * 5).cast("int")
    return F.repeat(F.lit(mark), n)


def age_text(later: Column, earlier: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", earlier, later)
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h ago")))
        .otherwise(F.concat(whole(86400), F.lit("d ago")))
    )
