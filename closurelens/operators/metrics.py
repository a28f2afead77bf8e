"""Exact classification metrics.

Scores are first aggregated to one row per distinct score.  The running sums
that AUC and AP need come from written range shards and the totals of earlier
shards (:mod:`closurelens.operators.ranks`) -- never a window over a single
partition, and never two evaluations of a sampled range cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def prefix_sums(df: DataFrame, order_col: str, value_cols: Sequence[str], descending: bool = False,
                partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_col`` order
    (``order_col`` unique).  Adds ``cum_<c>`` columns."""
    order = [F.col(order_col).desc() if descending else F.col(order_col).asc()]
    return ranks.running_sums(ranks.shards(df, [], order, "prefix", partitions), [], order,
                              {f"cum_{c}": F.col(c) for c in value_cols})


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("int")
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(y).cast("double").alias("pos"), F.sum(1 - y).cast("double").alias("neg"))


def roc_auc(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """Exact ROC-AUC with ties counted one half (W7, Mann-Whitney)."""
    sc = prefix_sums(score_counts(df, label, score), "score", ["neg"])
    # negatives strictly below = cum_neg - neg
    contrib = F.col("pos") * (F.col("cum_neg") - F.col("neg")) + 0.5 * F.col("pos") * F.col("neg")
    agg = sc.agg(F.sum(contrib).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """Step-wise average precision (W6): sum over distinct thresholds of
    recall increase x precision at that threshold."""
    sc = prefix_sums(score_counts(df, label, score), "score", ["pos", "neg"], descending=True)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    agg = sc.agg(F.sum(F.col("pos") * prec).alias("_s"), F.sum("pos").alias("_p"))
    return agg.select(F.try_divide(F.col("_s"), F.col("_p")).alias("average_precision"))


def confusion(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """Confusion counts (A17): one row per (actual, predicted)."""
    return df.groupBy(F.col(label).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))


def class_report(df: DataFrame, label: str = "y", pred: str = "pred", digits: int = 6) -> DataFrame:
    """Per-class precision / recall / F1 / support plus macro and weighted
    averages (A18): one aggregation of the (actual, predicted) cells into a
    single row, exploded into the report rows."""
    a, p = F.col(label).cast("int"), F.col(pred).cast("int")
    s = {}
    for k in (0, 1):
        s[f"tp{k}"] = F.count_if((a == k) & (p == k)).cast("double")
        s[f"pp{k}"] = F.count_if(p == k).cast("double")
        s[f"n{k}"] = F.count_if(a == k)
    row = df.agg(*[v.alias(k) for k, v in s.items()])
    parts = {}
    for k in (0, 1):
        prec = F.coalesce(F.try_divide(F.col(f"tp{k}"), F.col(f"pp{k}")), F.lit(0.0))
        rec = F.coalesce(F.try_divide(F.col(f"tp{k}"), F.col(f"n{k}").cast("double")), F.lit(0.0))
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        parts[k] = (prec, rec, f1, F.col(f"n{k}"))
    n = F.col("n0") + F.col("n1")

    def wavg(i):
        return F.try_divide(parts[0][i] * F.col("n0") + parts[1][i] * F.col("n1"), n.cast("double"))

    def rec(name, prec, rc, f1, sup):
        return F.struct(F.lit(name).alias("class"), prec.alias("precision"), rc.alias("recall"),
                        f1.alias("f1"), sup.cast("long").alias("support"))

    rows = F.array(
        rec("0", *parts[0]), rec("1", *parts[1]),
        rec("macro avg", (parts[0][0] + parts[1][0]) / 2, (parts[0][1] + parts[1][1]) / 2,
            (parts[0][2] + parts[1][2]) / 2, n),
        rec("weighted avg", wavg(0), wavg(1), wavg(2), n))
    out = row.select(F.explode(rows).alias("_r")).select("_r.*")
    return out.withColumns({m: F.round(m, digits) for m in ("precision", "recall", "f1")})
