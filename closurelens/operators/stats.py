"""Profiling and feature-selection statistics (A8, A9, A15, A16, A20, A21,
M4, M5, O6).  Each runs as one (or two) aggregation passes over the table;
only fixed-size results (per feature, per bin, p x p) leave the executors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import moments, ranks

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _stack(df: DataFrame, cols: Sequence[str], key: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot (narrow: one explode, no shuffle)."""
    return df.unpivot([], list(cols), key, value)


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count per column in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _stack(row, cols, "feature", "nulls")


def quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Exact quantiles (feature, share, value), linearly interpolated like pandas, of
    each column's non-null values; null if it has none.

    Equal values are counted first and their ranks come from range shards, so that no
    task holds a column: it holds a shard, and a value that most rows share is one
    row.  NaN ranks above all numbers."""
    long = _stack(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols).where("value IS NOT NULL")
    counted = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    order = [F.col("value").asc()]
    ranked = ranks.running_sums(ranks.shards(counted, ["feature"], order, "quantiles"), ["feature"], order, {"upto": F.col("n")})
    total = counted.groupBy(F.col("feature").alias("f")).agg(F.sum("n").alias("total"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")
    at = total.select("f", wanted, "total").withColumn("place", F.col("share") * (F.col("total") - 1) + 1)
    held = at.join(ranked, F.col("f") == F.col("feature"))
    inside = lambda r: (F.col("upto") - F.col("n") < r) & (F.col("upto") >= r)
    low, high = F.floor("place"), F.ceil("place")
    ends = held.where(inside(low) | inside(high)).groupBy("feature", "share", "place").agg(
        F.min("value").alias("low"), F.max("value").alias("high"))
    value = F.col("low") + (F.col("place") - F.floor("place")) * (F.col("high") - F.col("low"))
    return ends.select("feature", "share", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(value).alias("value"))


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """count, mean, sample std, min, quartiles, max (A9, pandas ``describe``): one
    aggregation pass, and exact quartiles by distributed ranks (:func:`quantiles`).
    ``exact=False`` uses ``percentile_approx`` (rank error 1/accuracy, no
    interpolation) in the same pass."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"), F.stddev_samp(x).alias(f"{c}|std"),
                 F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
        aggs += [] if exact else [F.percentile_approx(x, p, accuracy).alias(f"{c}|{q}") for q, p in QUARTILES.items()]
    row = df.agg(*aggs)
    stats = ["count", "mean", "std", "min", *([] if exact else QUARTILES), "max"]
    # one output row per column from the single aggregate row (no union of
    # branches re-reading the aggregate)
    per = F.array(*[F.struct(F.lit(c).alias("feature"),
                             *[F.col(f"`{c}|{s}`").cast("double").alias(s) for s in stats]) for c in cols])
    out = row.select(F.explode(per).alias("_d")).select("_d.*")
    if exact:
        q = quantiles(df, cols, list(QUARTILES.values())).groupBy("feature").agg(
            *[F.max(F.when(F.col("share") == p, F.col("value"))).alias(name) for name, p in QUARTILES.items()])
        out = out.join(q, "feature", "left")
    return out.select("feature", "count", "mean", "std", "min", *QUARTILES, "max")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width histogram per column (A20): bin in 1..bins over [min,max];
    the max value falls in the last bin.  Min/max per column come from one
    aggregate (a few rows, broadcast); binning and counting is one more pass."""
    long = _stack(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols)
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    rng = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = long.join(F.broadcast(rng), "feature")
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1,
                       F.lit(bins))).otherwise(F.lit(1)).cast("int")
    h = j.withColumn("bin", b).groupBy("feature", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("hi") - F.col("lo")) / bins
    return h.select("feature", "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * width).alias("bin_hi"), "count")


def density(df: DataFrame, col: str, grid: int = 50, bins: int = 512) -> DataFrame:
    """Gaussian kernel density on a grid (A21), Scott bandwidth, computed
    from binned counts: at most ``bins`` (value, count) pairs are gathered
    into one array per feature and the grid is evaluated with array
    functions, so no row-level join or cross product is needed."""
    x = F.col(col).cast("double")
    base = (df.select(F.lit(col).alias("feature"), x.alias("x"))
            .where(F.col("x").isNotNull() & ~F.isnan("x")))
    s = base.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                    F.count("x").alias("n"), F.stddev_samp("x").alias("sd"))
    lo, hi, n, sd = F.col("lo"), F.col("hi"), F.col("n").cast("double"), F.col("sd")
    b = F.when(hi > lo, F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    width = (hi - lo) / bins
    counts = (base.join(F.broadcast(s), "feature")
              .groupBy("feature", "lo", "hi", "n", "sd", b.alias("b")).agg(F.count(F.lit(1)).alias("c"))
              .groupBy("feature", "lo", "hi", "n", "sd")
              .agg(F.collect_list(F.struct((lo + (F.col("b") + 0.5) * width).alias("m"), F.col("c"))).alias("bins")))
    h = F.greatest(F.coalesce(sd, F.lit(0.0)) * F.pow(n, F.lit(-0.2)), F.lit(1e-12))
    pts = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: lo + i * (hi - lo) / (grid - 1))
    dens = F.transform(pts, lambda p: F.struct(p.alias("x"), (F.aggregate(
        "bins", F.lit(0.0),
        lambda acc, e: acc + e["c"] * F.exp(-0.5 * F.pow((p - e["m"]) / h, 2)))
        / (n * h * float(np.sqrt(2 * np.pi)))).alias("density")))
    return counts.select("feature", F.explode(dens).alias("d")).select(
        "feature", F.col("d.x").alias("x"), F.col("d.density").alias("density"))


def pearson(a, b) -> Column:
    """Pearson correlation over the rows that have both values, null if either does not
    vary there.  ``corr`` divides by the zero spread of such a column, an error
    under ANSI mode."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def corr_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, pairwise complete,
    sorted descending (A15); null if undefined, as in :func:`corr_matrix`."""
    row = df.agg(*[pearson(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    return _stack(row, cols, "feature", "corr").orderBy(F.col("corr").desc_nulls_last())


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairwise Pearson correlations, pairwise complete (A16), from the p x p
    moments of one pass.  Undefined (constant or empty) pairs are null."""
    def rows(m: np.ndarray) -> pd.DataFrame:
        n, _, squares, products = m
        both = squares * squares.T
        ok = (n > 1) & (both > 0)
        c = np.clip(products / np.sqrt(np.where(ok, both, 1.0)), -1.0, 1.0)
        return pd.DataFrame([(a, b, float(c[i, j]) if ok[i, j] else None)
                             for i, a in enumerate(cols) for j, b in enumerate(cols)], columns=["feature_a", "feature_b", "corr"])

    return moments.from_moments(df, cols, rows, "feature_a string, feature_b string, corr double")


def mutual_info(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) between each equal-width-binned column and
    the label (M5): unpivot, bin, count (feature, bin, y) cells, then
    sum p(x,y) ln(p(x,y)/(p(x)p(y))) per feature.  Nulls count as 0 like the
    reference's ``fillna(0)``."""
    base = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols],
                     F.col(label).alias("y"))
    long = base.unpivot(["y"], list(cols), "feature", "value")
    rng = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                       F.lit(bins - 1))).otherwise(F.lit(0))
    cells = (long.join(F.broadcast(rng), "feature").withColumn("bin", b)
             .groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n")))
    wf = Window.partitionBy("feature")
    c = (cells.withColumn("tot", F.sum("n").over(wf))
         .withColumn("nx", F.sum("n").over(Window.partitionBy("feature", "bin")))
         .withColumn("ny", F.sum("n").over(Window.partitionBy("feature", "y"))))
    term = (F.col("n") / F.col("tot")) * F.log((F.col("n") * F.col("tot")) / (F.col("nx") * F.col("ny")))
    return (c.groupBy("feature").agg(F.round(F.sum(term), 6).alias("mutual_info"))
            .orderBy(F.col("mutual_info").desc(), "feature"))


def group_top(scores: DataFrame, groups: Mapping[str, Sequence[str]], feature: str = "feature",
              score: str = "mutual_info") -> DataFrame:
    """Best feature of each named group (O6): feature -> group map is a
    bounded literal; ``max_by`` with a name tie-break."""
    m = F.create_map(*[x for g, fs in groups.items() for f in fs for x in (F.lit(f), F.lit(g))])
    s = scores.withColumn("group", m[F.col(feature)]).where(F.col("group").isNotNull())
    w = Window.partitionBy("group").orderBy(F.col(score).desc(), F.col(feature))
    return (s.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("group", feature, score))


def vif(df: DataFrame, cols: Sequence[str], centered: bool = False, high: float = 10.0) -> DataFrame:
    """Variance inflation factors (M4) after fill-0.  Uncentred (no
    intercept) like the reference's call: VIF_i = G_ii * (G^-1)_ii with
    G = X^T X.  ``centered=True`` uses the covariance matrix instead.
    The matrix is scaled to unit diagonal first and every feature is judged by
    its own tolerance 1 - R^2 against the others, so badly scaled columns do no
    harm and only a feature in an exact dependency (or without variation) gives
    Infinity.  ``high_vif`` flags VIF > ``high`` (F13)."""
    def rows(m: np.ndarray) -> pd.DataFrame:
        n, mean, _, products = m
        around = products + (0.0 if centered else n * mean * mean.T)
        M = around / max(n[0, 0], 1)
        raw = np.diag(products + n * mean * mean.T) / max(n[0, 0], 1)
        flat = np.diag(M) <= (1e-14 if centered else 0.0) * raw
        scale = np.where(flat, 1.0, np.sqrt(np.clip(np.diag(M), 0, None)))
        C = M / np.outer(scale, scale)
        out = []
        for i, c in enumerate(cols):
            rest = [j for j in range(len(cols)) if j != i and not flat[j]]
            r = C[rest, i]
            left = 1.0 - float(r @ np.linalg.pinv(C[np.ix_(rest, rest)], rcond=1e-13, hermitian=True) @ r) if rest else 1.0
            out.append((c, float("inf") if flat[i] or left < 1e-10 else 1.0 / min(1.0, left)))
        return pd.DataFrame(out, columns=["feature", "vif"])

    filled = df.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols])
    res = moments.from_moments(filled, cols, rows, "feature string, vif double")
    return res.withColumn("high_vif", (F.col("vif") > high).cast("int")).orderBy(F.col("vif").desc())
