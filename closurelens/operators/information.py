"""Mutual information of features and a class label (M5), in nats.

Two estimators beside the equal-width one of :mod:`closurelens.operators.stats`:
quantile bins, and nearest neighbours (Ross 2014, for a class label; equal values
as in Gao et al. 2017).  Both count equal (feature, class, value) rows first, so
that a value that most rows share is one row, and both take ranks from range
shards, so that a feature is spread over all tasks.

Nulls and NaN count as 0 like the reference's ``fillna(0)``; rows without a label
take no part; a feature of one value has 0; no rows give no rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

NEIGHBOURS = 3


def _cells(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, y, value, n): equal rows counted."""
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols]
    long = df.where(F.col(label).isNotNull()).select(*x, F.col(label).alias("y")).unpivot(["y"], list(cols), "feature", "value")
    # 0.0 and -0.0 are one value
    return long.groupBy("feature", "y", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count("*").alias("n"))


def _from_counts(cells: DataFrame, part: str) -> DataFrame:
    """Plug-in estimate from (feature, part, y, n)."""
    over = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    c = cells.withColumns({"tot": over(), "nx": over(part), "ny": over("y")})
    term = F.col("n") / F.col("tot") * F.log(F.col("n") * F.col("tot") / (F.col("nx") * F.col("ny")))
    return c.groupBy("feature").agg(F.round(F.sum(term), 6).alias("mutual_info")).orderBy(F.desc("mutual_info"), "feature")


def mutual_info_quantiles(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of the label and each feature's quantile bin: a value's bin
    is floor(bins * share of the rows below it), so equal values share a bin."""
    cells = _cells(df, cols, label)
    values = cells.groupBy("feature", "value").agg(F.sum("n").alias("rows"))
    order = [F.col("value").asc()]
    ranked = ranks.running_sums(ranks.shards(values, ["feature"], order, "mi-values"), ["feature"], order, {"upto": F.col("rows")})
    total = values.groupBy("feature").agg(F.sum("rows").alias("total"))
    ranked = ranked.join(total, "feature").select(
        "feature", "value", F.floor((F.col("upto") - F.col("rows")) * bins / F.col("total")).alias("bin"))
    return _from_counts(cells.join(ranked, ["feature", "value"]).groupBy("feature", "bin", "y").agg(F.sum("n").alias("n")), "bin")


def digamma(x: Column) -> Column:
    """The digamma function of a positive number: eight steps of its recurrence, then
    its series."""
    z = x.cast("double") + 8
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6) + 1 / (240 * z ** 8)
    for j in range(8):
        series = series - 1 / (x.cast("double") + j)
    return series


def _radii(k: int):
    """Per (feature, class, shard) with its halo: the open interval that reaches to the
    k-th nearest row of the class (closed and of no width among k equal rows)."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("value")
        v, n, want = f.value.to_numpy(), f.n.to_numpy(), np.minimum(k, f.ny.to_numpy() - 1)
        near, count = [np.zeros(len(v))], [n - 1]
        for step in range(1, k + 1):
            for sign in (-1, 1):
                at = np.arange(len(v)) + sign * step
                ok = (at >= 0) & (at < len(v))
                at = np.clip(at, 0, len(v) - 1)
                near.append(np.where(ok, sign * np.abs(v[at] - v), np.inf))
                count.append(np.where(ok, n[at], 0))
        near, count = np.array(near).T, np.array(count).T
        order = np.argsort(np.abs(near), axis=1, kind="stable")
        upto = np.cumsum(np.take_along_axis(count, order, axis=1), axis=1)
        d = near[np.arange(len(v)), order[np.arange(len(v)), np.argmax(upto >= want[:, None], axis=1)]]
        out = f.assign(lo=v - np.abs(d), hi=v + np.abs(d), same=np.where(d == 0, n, want), tie=d == 0)
        return out.loc[~out._halo, ["feature", "y", "value", "n", "ny", "lo", "hi", "same", "tie"]]

    return run


def mutual_info_neighbours(df: DataFrame, cols: Sequence[str], label: str, k: int = NEIGHBOURS) -> DataFrame:
    """Nearest-neighbour mutual information of each feature and the label:
    psi(N) + <psi(k_i)> - <psi(N_y)> - <psi(m_i)> over the rows of classes of two rows
    or more, cut at 0.  Row i's radius is its distance to the k-th nearest row of its
    class (all others, if fewer), m_i counts the rows of all classes inside the
    radius, itself included; where k rows of the class equal it, k_i and m_i count
    the equal rows of its class and of all.  No noise breaks ties.

    A row's neighbours lie in its shard or in the k rows beside it.  m_i is the
    difference of two ranks, which the interval's ends get as events sorted among
    the values of the feature."""
    cells = _cells(df, cols, label)
    sizes = cells.groupBy(F.col("feature").alias("f"), F.col("y").alias("c")).agg(F.sum("n").alias("ny")).where("ny > 1")
    kept = cells.join(sizes, (F.col("feature") == F.col("f")) & (F.col("y") == F.col("c"))).drop("f", "c")
    sharded = ranks.shards(kept, ["feature", "y"], [F.col("value").asc()], "mi-classes")
    kind = sharded.schema["y"].dataType.simpleString()
    found = ranks.materialize(
        ranks.with_halo(sharded, ["feature", "y"], ["value"], k).groupBy("feature", "y", ranks.SHARD).applyInPandas(
            _radii(k), f"feature string, y {kind}, value double, n long, ny long, lo double, hi double, same long, tie boolean"),
        "mi-radii")
    # at equal places: 0 ends that exclude the place, 1 rows, 2 ends that include it
    ends = [("lo", F.when(F.col("tie"), 0).otherwise(2), -1), ("hi", F.when(F.col("tie"), 2).otherwise(0), 1)]
    events = sharded.groupBy("feature", F.col("value").alias("place")).agg(F.sum("n").alias("rows")).select(
        "feature", "place", F.lit(1).alias("kind"), "rows", F.lit(None).cast(kind).alias("y"),
        F.lit(None).cast("double").alias("value"), F.lit(0).alias("sign"))
    for end, at, sign in ends:
        events = events.union(found.select("feature", end, at, F.lit(0).cast("long"), "y", "value", F.lit(sign)))
    order = [F.col("place").asc(), F.col("kind").asc()]
    ranked = ranks.running_sums(ranks.shards(events, ["feature"], order, "mi-ends"), ["feature"], order, {"upto": F.col("rows")})
    inside = ranked.where("sign <> 0").groupBy("feature", "y", "value").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / F.sum("n")
    value = digamma(F.sum("n")) + mean("same") - mean("ny") - mean("m")
    some = found.join(inside, ["feature", "y", "value"]).groupBy("feature").agg(
        F.round(F.greatest(value, F.lit(0.0)), 6).alias("mutual_info"))
    # a feature whose classes have one row each gives nothing to measure
    return (cells.select("feature").distinct().join(some, "feature", "left")
            .select("feature", F.coalesce("mutual_info", F.lit(0.0)).alias("mutual_info"))
            .orderBy(F.desc("mutual_info"), "feature"))
