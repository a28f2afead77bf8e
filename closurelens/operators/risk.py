"""Risk index and ranked reports (M20, M21, X21, X23, A13, A14, A25, O2-O4,
O11), plus cluster KPIs (A10-A12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import stable_round

# fixed values: risk weights of the reference
RISK_WEIGHTS = {"model": 0.8, "affiliation": 0.1, "visitors": 0.05, "station": 0.05}


def risk_raw(prob: Column, affiliation: Column, visitors: Column, station: Column,
             weights: Mapping[str, float] = RISK_WEIGHTS) -> Column:
    """``0.8 p + 0.1 (1-aff) + 0.05 (1-visitors) + 0.05 (1-station)``.
    ``visitors`` is log-scaled upstream as in the reference (trap 3)."""
    return (prob * weights["model"] + (1 - affiliation) * weights["affiliation"]
            + (1 - visitors) * weights["visitors"] + (1 - station) * weights["station"])


def min_max(df: DataFrame, col: str, name: str) -> DataFrame:
    """Min-max scale to 0-1 (X21, A25); 0 when the column is constant.
    min and max are scalar subqueries: evaluated once, no join."""
    lo = df.select(F.min(col)).scalar()
    hi = df.select(F.max(col)).scalar()
    return df.withColumn(name, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(F.lit(0.0)))


def risk_score(df: DataFrame, prob_col: str, *, affiliation="affiliation_rate",
               visitors="visitors", station="station_rate",
               weights: Mapping[str, float] = RISK_WEIGHTS) -> DataFrame:
    raw = risk_raw(F.col(prob_col), F.col(affiliation), F.col(visitors), F.col(station), weights)
    return min_max(df.withColumn("risk_raw", raw), "risk_raw", "risk_score")


def top_groups(df: DataFrame, keys: Sequence[str], value: str = "risk_score", n: int = 10,
               label: str | None = None, name: str = "mean_risk") -> DataFrame:
    """Top-n groups by mean value (A13 + O2-O4): null keys are dropped like
    pandas ``groupby`` (trap 19); ties broken by key.  ``label`` adds
    ``"a - b"`` of the keys.  Planned as a partial aggregate and a
    TakeOrderedAndProject."""
    g = df
    for k in keys:
        g = g.where(F.col(k).isNotNull())
    g = g.groupBy(*keys).agg(F.round(F.avg(value), 6).alias(name))
    if label:
        g = g.withColumn(label, F.concat_ws(" - ", *keys))
    return g.orderBy(F.col(name).desc(), *keys).limit(n)


def benchmarks(df: DataFrame, value: str = "risk_score",
               groupings: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Row-level mean vs mean of group means (A14): every grouping and the
    overall mean come from ONE aggregation with GROUPING SETS (one pass, one
    shuffle of partial aggregates)."""
    groupings = groupings or {"dong": ["dong"], "industry": ["industry"],
                              "district_industry": ["district", "industry"]}
    cols = sorted({c for ks in groupings.values() for c in ks})
    sets = [[F.col(c) for c in ks] for ks in groupings.values()] + [[]]
    g = df.groupingSets(sets, *cols).agg(F.avg(value).alias("_m"), F.grouping_id().alias("_gid"))

    def gid(ks):
        bits = 0
        for i, c in enumerate(cols):
            if c not in ks:
                bits |= 1 << (len(cols) - 1 - i)
        return bits

    aggs = []
    for name, ks in groupings.items():
        # group means over non-null keys only (pandas drops null group keys)
        cond = F.col("_gid") == gid(ks)
        for k in ks:
            cond = cond & F.col(k).isNotNull()
        aggs.append(F.round(F.avg(F.when(cond, F.col("_m"))), 6).alias(f"{name}_mean_of_means"))
    aggs.append(F.round(F.max(F.when(F.col("_gid") == gid([]), F.col("_m"))), 6).alias("row_mean"))
    return g.agg(*aggs)


def rule_cluster(closure="closure_rate", affiliation="affiliation_rate",
                 closure_cut=0.1, affiliation_cut=0.3) -> Column:
    """Rule-based cluster id in 0..3 (stand-in for k-means ids in KPI
    reports): 2 * high closure + high affiliation."""
    return ((F.col(closure) > closure_cut).cast("int") * 2
            + (F.col(affiliation) > affiliation_cut).cast("int"))


def cluster_profile(df: DataFrame, cluster: str, features: Sequence[str], digits: int = 3) -> DataFrame:
    """Mean of each feature per cluster, rounded (A10)."""
    return df.groupBy(cluster).agg(*[stable_round(F.avg(f), digits).alias(f) for f in features])


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("rows")).orderBy(cluster)


def cluster_roles(df: DataFrame, cluster: str, closure="closure_rate",
                  affiliation="affiliation_rate") -> DataFrame:
    """Name clusters by profile (trap 23): danger = highest mean closure
    rate; opportunity = lowest mean affiliation among the others.  Works on
    the per-cluster profile (k rows)."""
    prof = df.groupBy(cluster).agg(F.avg(closure).alias("_cl"), F.avg(affiliation).alias("_af"))
    danger = prof.orderBy(F.col("_cl").desc(), cluster).select(cluster).limit(1).scalar()
    opp = (prof.where(F.col(cluster) != danger).orderBy(F.col("_af").asc(), cluster)
           .select(cluster).limit(1).scalar())
    return df.withColumn("role", F.when(F.col(cluster) == danger, F.lit("danger"))
                         .when(F.col(cluster) == opp, F.lit("opportunity"))
                         .otherwise(F.lit("other")))


def cluster_kpi(df: DataFrame, cluster: str, closure="closure_rate",
                affiliation="affiliation_rate") -> DataFrame:
    """Closure and affiliation means x100 for danger, opportunity and
    non-danger rows in ONE aggregation (A12, F12, X40)."""
    r = cluster_roles(df, cluster, closure, affiliation)

    def pct(c, cond):
        return stable_round(F.round(F.avg(F.when(cond, F.col(c))), 9) * 100, 2)

    dz, op = F.col("role") == "danger", F.col("role") == "opportunity"
    return r.agg(pct(closure, dz).alias("danger_closure_pct"),
                 pct(affiliation, dz).alias("danger_affiliation_pct"),
                 pct(closure, op).alias("opportunity_closure_pct"),
                 pct(affiliation, op).alias("opportunity_affiliation_pct"),
                 pct(closure, ~dz).alias("non_danger_closure_pct"),
                 pct(affiliation, ~dz).alias("non_danger_affiliation_pct"))
