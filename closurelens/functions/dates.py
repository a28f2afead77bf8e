"""Month-key expressions.  A month key is the string ``YYYY-MM`` at the
boundary and a DATE (first of month) inside plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_to_date(c) -> Column:
    """``'YYYY-MM'`` -> DATE of the month start; null when malformed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(F.concat(c, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")


def date_to_key(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM")


def compact_to_key(c) -> Column:
    """``'YYYYMM'`` -> ``'YYYY-MM'``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 2))


def months_between_keys(start, end) -> Column:
    """Whole months from ``start`` to ``end`` month keys (X3, replaces the
    reference's row UDF): ``(y2-y1)*12 + (m2-m1)``; null unless both keys split
    into exactly two integer parts."""
    s = F.split(F.col(start) if isinstance(start, str) else start, "-")
    e = F.split(F.col(end) if isinstance(end, str) else end, "-")

    def part(a, i):
        return F.get(a, i).try_cast("int")

    ok = (F.size(s) == 2) & (F.size(e) == 2)
    val = (part(e, 0) - part(s, 0)) * 12 + (part(e, 1) - part(s, 1))
    return F.when(ok, val)


def month_number(c) -> Column:
    """Calendar month (1-12) of a month key."""
    return F.month(key_to_date(c))
