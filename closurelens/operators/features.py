"""Feature engineering on the panel (X19-X22, W3, W4, W8, F11, M1, O9, O10,
M13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_number
from ..functions.numeric import flag, nan_to_null, parse_numeric, safe_log1p
from . import ranks


def label_codes(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Label encoding = rank of the value among the sorted distinct values,
    from 0 (W8).  The distinct values are ranked with the distributed prefix
    sum (range partitioning + per-partition offsets), not a single-partition
    window, and joined back; AQE turns the join into a broadcast at run time
    when the measured distinct set is small."""
    from .metrics import prefix_sums
    out = df
    for c in cols:
        dim = df.select(c).where(F.col(c).isNotNull()).distinct().withColumn("_one", F.lit(1.0))
        ranked = prefix_sums(dim, c, ["_one"])
        dim = ranked.select(c, (F.col("cum__one") - 1).cast("int").alias(f"{c}{suffix}"))
        out = out.join(dim, c, "left")
    return out


def parse_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: parse_numeric(c) for c in cols})


def log_columns(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": safe_log1p(c) for c in cols})


def rolling_mean(df: DataFrame, value: str, partition: Sequence[str], order: Sequence[str],
                 rows: int = 3, name: str | None = None) -> DataFrame:
    """Trailing mean over ``rows`` rows, ``min_periods=1`` (W3).  The
    reference rolls in file order; ours orders by ``order`` (trap 1)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name or f"{value}_rolling", F.avg(value).over(w))


def rolling_trend(df: DataFrame, value: str, partition: Sequence[str], order: Sequence[str],
                  rows: int = 3, name: str = "trend") -> DataFrame:
    """Deviation of a value from its trailing mean."""
    tmp = f"_{value}_roll"
    return (rolling_mean(df, value, partition, order, rows, tmp)
            .withColumn(name, F.col(value) - F.col(tmp)).drop(tmp))


def closure_label(df: DataFrame, rate: str = "closure_rate", name: str = "closed_label") -> DataFrame:
    """Label = rate > 0 on the ROUNDED rate (traps 2 and 29); null and NaN rates
    give 0 (trap 20)."""
    return df.withColumn(name, flag(nan_to_null(F.col(rate).cast("double")) > 0))


def add_month_number(df: DataFrame, month_col: str = "month", name: str = "month_num") -> DataFrame:
    return df.withColumn(name, month_number(month_col))


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """z-score with the POPULATION std (X20, as the reference's scaler).
    Means and stds come from one aggregate evaluated as scalar subqueries,
    so no join or single-partition window is needed."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    out = df
    for c in cols:
        m = stats.select(f"m_{c}").scalar()
        s = stats.select(f"s_{c}").scalar()
        out = out.withColumn(f"{c}{suffix}", F.when(s > 0, (F.col(c) - m) / s).otherwise(F.lit(0.0)))
    return out


def key_hash(cols: Sequence[str], seed: int):
    """A 60-bit number from the seed and the key columns as text, by MD5: the same in
    any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])), 1, 15), 16, 10).cast("long")


def hash_bucket(cols: Sequence[str], seed: int, buckets: int = 100):
    """Stable pseudo-random bucket of a row from its key columns."""
    return F.pmod(key_hash(cols, seed), F.lit(buckets))


def hash_split(df: DataFrame, key_cols: Sequence[str], seed: int = 42, test_pct: int = 20,
               name: str = "split") -> DataFrame:
    """80/20 train/test assignment by key hash (O10): stable across
    re-partitioning and re-runs, unlike ``randomSplit``."""
    return df.withColumn(name, F.when(hash_bucket(key_cols, seed) < test_pct, F.lit("test"))
                         .otherwise(F.lit("train")))


#: hash cells of the sample; their counts are the only rows that meet in one task
SAMPLE_CELLS = 4096


def hash_sample(df: DataFrame, key_cols: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Fixed-size sample (O9): exactly the ``n`` rows with the smallest key hash (all, if
    fewer; ties by the key columns) -- independent of partitioning and re-runs.

    Rows are counted in hash cells of equal width.  Cells that begin below the
    n-th row take part; row numbers inside them, one task a cell, finish the
    cell in which the n-th row lies.  No job runs while the plan is built."""
    hashed = df.withColumn("_h", key_hash(key_cols, seed)).withColumn(
        "_cell", F.shiftright("_h", 60 - SAMPLE_CELLS.bit_length() + 1))
    earlier = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    cells = hashed.groupBy(F.col("_cell").alias("_c")).count().select(
        "_c", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    near = hashed.join(F.broadcast(cells.where(F.col("_before") < n)), F.col("_cell") == F.col("_c"))
    inside = Window.partitionBy("_cell").orderBy("_h", *key_cols)
    return (near.withColumn("_r", F.col("_before") + F.row_number().over(inside)).where(F.col("_r") <= n)
            .drop("_h", "_cell", "_c", "_before", "_r"))


def stratified_folds(df: DataFrame, key_cols: Sequence[str], label: str, k: int = 3,
                     seed: int = 42, name: str = "fold") -> DataFrame:
    """Stratified k-fold ids (M13): within each class, rows are dealt round
    robin in key-hash order by their exact row number, so the folds of a class
    differ by one row at most, however large the class is."""
    hashed = df.withColumn("_h", key_hash(key_cols, seed))
    order = [F.col("_h").asc(), *[F.asc_nulls_first(c) for c in key_cols]]
    numbered = ranks.row_numbers(hashed, [label], order, "_fold_row")
    return numbered.withColumn(name, F.pmod(F.col("_fold_row") - 1, F.lit(k)).cast("int")).drop("_h", "_fold_row")
