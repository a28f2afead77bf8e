"""Establishment cleaning (filter script): lenient parsing, study-window
filter, completeness filter, mode-based fill (X1, X2, X38, X39, F4, F5, F11,
A4, J11, J12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import empty_to_null, null_to_empty


def lenient_timestamp(c, fmt: str = "yyyy-MM-dd") -> Column:
    """Unparseable text -> null instead of an error (X1, pandas
    ``errors='coerce'``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(c.cast("string"), F.lit(fmt))


def study_window(df: DataFrame, open_col: str, close_col: str, start, end,
                 flag_col: str = "closed_flag") -> DataFrame:
    """Keep rows opened by ``end`` that are still open or closed inside
    [start, end] (F4); a null open date drops the row, an unparseable close
    date counts as open (trap 18).  Adds the 0/1 closed flag (F11)."""
    o, c = F.col(open_col), F.col(close_col)
    keep = (o <= F.lit(end)) & (c.isNull() | c.between(F.lit(start), F.lit(end)))
    return df.where(keep).withColumn(flag_col, c.isNotNull().cast("int"))


def drop_incomplete(df: DataFrame, subset: Sequence[str], blank_fill: Sequence[str] = ()) -> DataFrame:
    """Drop rows with a null in any of ``subset`` (F5), then render
    ``blank_fill`` columns as strings with nulls as '' (X38)."""
    out = df.na.drop(how="any", subset=list(subset))
    return out.withColumns({c: null_to_empty(c) for c in blank_fill})


def mode_fill(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Fill missing ``cols`` with the per-``key`` mode computed on rows where
    all ``cols`` are present (A4, J11, J12).  '' counts as missing (X39).
    Modes are independent per column (trap 16); ties go to the smallest
    value.  Computed in two aggregation stages on the unpivoted values:
    (key, column, value) counts, then ``min_by`` per (key, column) -- both
    modes in one shuffle, and a hot key is pre-aggregated map-side before it
    moves.  The mode table has one row per key and column."""
    base = df.withColumns({c: empty_to_null(c) for c in cols})
    valid = base.where(F.greatest(*[F.col(c).isNull() for c in cols]) == F.lit(False)) if len(cols) > 1 \
        else base.where(F.col(cols[0]).isNotNull())
    long = valid.select(F.col(key).cast("string").alias("_k"), *cols).unpivot(["_k"], list(cols), "_c", "_v")
    counts = long.groupBy("_k", "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    modes = counts.groupBy("_k", "_c").agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("_mode"))
    wide = modes.groupBy("_k").pivot("_c", list(cols)).agg(F.first("_mode"))
    wide = wide.select("_k", *[F.col(c).alias(f"_mode_{c}") for c in cols])
    j = base.join(wide, base[key].cast("string") == wide["_k"], "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_mode_{c}")) for c in cols}).drop(
        "_k", *[f"_mode_{c}" for c in cols])
