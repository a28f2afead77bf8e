"""Transactions join, structural zeros, group-mean imputation, exclusions and
their audit (J5, J7, W2, X16-X18, Q2).

The reference evaluates its windowed mean three times (fill, two anti-joins).
Here one window pass computes the means and an ``impute_status`` per row; the
exclusions are a second window on a finer key that Spark evaluates on the same
partitioning (no extra shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("tx_count", "tx_amount", "avg_ticket")
MEAN_KEYS = ("dong", "industry")
JOIN_KEYS = ("month", "dong", "industry")

PRESENT, STRUCTURAL_ZERO, OVERRIDDEN, IMPUTED, ZERO_MEAN, NO_MEAN, OTHER = (
    "present", "structural_zero", "zero_override", "imputed", "zero_mean", "no_mean", "other")


def attach(panel: DataFrame, tx: DataFrame, keys: Sequence[str] = JOIN_KEYS,
           measures: Sequence[str] = MEASURES) -> DataFrame:
    """Left join of the panel with the transaction cells (J5).  ``tx`` must
    be unique on ``keys`` (it is the output of a grouped aggregation)."""
    return panel.join(tx.select(*keys, *measures), list(keys), "left")


def structural_zero(df: DataFrame, rate_col: str = "affiliation_rate",
                    measures: Sequence[str] = MEASURES) -> DataFrame:
    """Rate 0 => measures 0 even when present (X16; trap 8 kept)."""
    return df.withColumns({m: F.when(F.col(rate_col) == 0, F.lit(0)).otherwise(F.col(m))
                           for m in measures})


def with_group_means(df: DataFrame, group_keys: Sequence[str] = MEAN_KEYS,
                     measures: Sequence[str] = MEASURES) -> DataFrame:
    """Unordered partition mean over all months (W2); nulls are ignored."""
    w = Window.partitionBy(*group_keys)
    return df.withColumns({f"mean_{m}": F.avg(m).over(w) for m in measures})


def impute_status(basis: str = "tx_count", rate_col: str = "affiliation_rate",
                  missing_col: str = "_missing") -> Column:
    """Case of each row, defined on ``basis`` only (trap 10).  ``missing_col``
    holds whether ``basis`` was null before the structural zero."""
    miss = F.col(missing_col)
    rate = F.col(rate_col)
    mean = F.col(f"mean_{basis}")
    return (F.when((rate == 0) & miss, F.lit(STRUCTURAL_ZERO))
            .when(rate == 0, F.lit(OVERRIDDEN))
            .when(~miss, F.lit(PRESENT))
            .when((rate != 0) & mean.isNull(), F.lit(NO_MEAN))
            .when((rate != 0) & (mean == 0), F.lit(ZERO_MEAN))
            .when(rate != 0, F.lit(IMPUTED))
            .otherwise(F.lit(OTHER)))


def impute_group_mean(df: DataFrame, rate_col: str = "affiliation_rate",
                      measures: Sequence[str] = MEASURES, group_keys: Sequence[str] = MEAN_KEYS,
                      basis: str = "tx_count", keep_status: bool = True) -> DataFrame:
    """Structural zero, then null & rate != 0 -> group mean, null & rate = 0
    -> 0, then remaining nulls -> 0 (X16-X18).  Adds ``impute_status``."""
    z = df.withColumn("_missing", F.col(basis).isNull())
    z = with_group_means(structural_zero(z, rate_col, measures), group_keys, measures)
    z = z.withColumn("impute_status", impute_status(basis, rate_col))
    rate_nz = F.col(rate_col) != 0
    filled = {m: F.coalesce(
        F.when(F.col(m).isNull() & rate_nz, F.col(f"mean_{m}"))
        .when(F.col(m).isNull() & (F.col(rate_col) == 0), F.lit(0))
        .otherwise(F.col(m)).cast("double"), F.lit(0.0)) for m in measures}
    out = z.withColumns(filled).drop("_missing", *[f"mean_{m}" for m in measures])
    return out if keep_status else out.drop("impute_status")


def impute_exclude(imputed: DataFrame, exclusion_keys: Sequence[str] = JOIN_KEYS) -> DataFrame:
    """Drop every row whose ``exclusion_keys`` cell holds a zero-mean or a
    no-mean row (J7).  The reference anti-joins on keys without the district
    (trap 9): same-named dongs in two districts go together.  A window on the
    keys replaces both anti joins."""
    bad = F.col("impute_status").isin(ZERO_MEAN, NO_MEAN)
    w = Window.partitionBy(*exclusion_keys)
    return (imputed.withColumn("_bad", F.max(bad.cast("int")).over(w))
            .where(F.col("_bad") == 0).drop("_bad"))


def impute_audit(imputed: DataFrame) -> DataFrame:
    """Counts per imputation case (Q2); the cases partition the rows."""
    return imputed.groupBy("impute_status").agg(F.count(F.lit(1)).alias("rows"))
