"""Numeric helper expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_numeric(c) -> Column:
    """Lenient number parse: thousands separators removed, bad text -> null
    (X2).  ``try_cast`` keeps ANSI mode from raising."""
    return F.replace(_c(c).cast("string"), F.lit(","), F.lit("")).try_cast("double")


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(~F.isnan(c), c)


def guarded_ratio(num, den, scale: int = 2) -> Column:
    """``round(num/den, scale)`` when ``den > 0`` else 0."""
    num, den = _c(num), _c(den)
    return F.round(F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(0.0)), scale)


def safe_log1p(c) -> Column:
    """``log1p`` defined for ``x >= 0`` (X19, F16); null otherwise."""
    c = _c(c)
    return F.when(c >= 0, F.log1p(c))


def flag(pred: Column) -> Column:
    """0/1 flag from a predicate; a null predicate gives 0 like pandas."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def empty_to_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def null_to_empty(c) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def stable_round(c, digits: int) -> Column:
    """Round a mean of short decimals to ``digits``: first to 9 decimals,
    which removes summation-order noise (~1e-16 relative), so an exact tie
    such as 1.425 rounds the same way whatever the partitioning."""
    return F.round(F.round(_c(c), 9), digits)
