"""Tree attributions for the gradient-boosted classifier.

Exact path-dependent TreeSHAP (Lundberg, Erion & Lee 2018; Lundberg et al.
2020): for a leaf l with value v_l, let F_l be the features split on along
its path, z_j the fraction of training cover that follows the path at the
splits on feature j, and o_j(x) in {0,1} whether x follows them.  The
conditional expectation the algorithm explains is
    f_S(x) = sum_l v_l prod_{j in F_l} (o_j(x) if j in S else z_j),
a sum of product games, whose Shapley values are
    phi_i = sum_l v_l (o_i - z_i) sum_k c_k(i) k! (d-1-k)! / d!,   d = |F_l|,
with c_k(i) the coefficients of prod_{j in F_l, j != i} (z_j + o_j t).  The
polynomial is evaluated for a whole Arrow batch of rows at once with numpy.

The model (a few thousand nodes) is read from its saved form with Spark and
shipped to the tasks in the closure; the rows are distributed with
``mapInPandas``.  Spark's GBT margin is sum_t w_t tree_t(x) and
P(1) = 1 / (1 + exp(-2 margin)), so attributions are scaled by 2 to explain
the log-odds: base + sum(phi) = 2 * margin."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stats import pearson


def read_trees(spark: SparkSession, gbt_path: str) -> list[dict]:
    """Node tables of a saved GBT model (its ``data`` folder)."""
    rows = (spark.read.parquet(f"{gbt_path}/data")
            .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
                    "nodeData.rawCount", "nodeData.leftChild", "nodeData.rightChild",
                    "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold")
            .collect())
    trees: dict[int, dict] = {}
    for r in rows:
        t = trees.setdefault(r["treeID"], {})
        stats = r["impurityStats"]
        cover = float(stats[0]) if stats and stats[0] > 0 else float(r["rawCount"])
        thr = r["leftCategoriesOrThreshold"]
        t[r["id"]] = (r["prediction"], cover, r["leftChild"], r["rightChild"], r["featureIndex"],
                      float(thr[0]) if thr else 0.0)
    return [trees[k] for k in sorted(trees)]


def leaf_paths(tree: dict, root: int = 0) -> list[tuple[float, float, list]]:
    """(value, cover share, [(feature, threshold, goes_left, child/parent
    cover)]) for every leaf, by depth-first walk."""
    out = []

    def walk(node, path, share):
        pred, cover, left, right, feat, thr = tree[node]
        if left < 0:
            out.append((pred, share, path))
            return
        for child, go_left in ((left, True), (right, False)):
            frac = tree[child][1] / cover if cover > 0 else 0.0
            walk(child, path + [(feat, thr, go_left, frac)], share * frac)

    walk(root, [], 1.0)
    return out


def compile_model(trees: list[dict], weights: Sequence[float], scale: float = 2.0) -> dict:
    """Per leaf: scaled value and per-feature (z_j, [(thr, go_left)])."""
    leaves = []
    base = 0.0
    for tree, w in zip(trees, weights):
        for value, share, path in leaf_paths(tree):
            v = scale * w * value
            base += v * share
            feats: dict[int, list] = {}
            for feat, thr, go_left, frac in path:
                z, conds = feats.get(feat, (1.0, []))
                feats[feat] = (z * frac, conds + [(thr, go_left)])
            leaves.append((v, feats))
    return {"base": base, "leaves": leaves}


def compile_boosted(model, scale: float = 1.0) -> dict:
    """Leaves of a :class:`closurelens.operators.boosting.BoostedModel`: its margin is the
    log-odds, its cover the sum of Hessians."""
    return compile_model([{n: x[:6] for n, x in tree.items()} for tree in model.trees], [1.0] * len(model.trees), scale)


def _weights(d: int) -> np.ndarray:
    return np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])


def shap_matrix(X: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """phi (n x p) and the model output f(x) (n,) for a batch of rows;
    base + phi.sum(axis=1) == f(x)."""
    n, p = X.shape
    phi = np.zeros((n, p))
    fx = np.zeros(n)
    for v, feats in model["leaves"]:
        fl = list(feats)
        d = len(fl)
        if d == 0:
            fx += v
            continue
        Z = np.array([feats[f][0] for f in fl])
        O = np.ones((n, d))
        for j, f in enumerate(fl):
            ok = np.ones(n, dtype=bool)
            for thr, go_left in feats[f][1]:
                ok &= (X[:, f] <= thr) if go_left else (X[:, f] > thr)
            O[:, j] = ok
        fx += v * O.prod(axis=1)
        wts = _weights(d)
        for i in range(d):
            c = np.zeros((n, d))
            c[:, 0] = 1.0
            deg = 0
            for j in range(d):
                if j == i:
                    continue
                c[:, 1:deg + 2] = c[:, 1:deg + 2] * Z[j] + c[:, 0:deg + 1] * O[:, j:j + 1]
                c[:, 0] = c[:, 0] * Z[j]
                deg += 1
            phi[:, fl[i]] += v * (O[:, i] - Z[i]) * (c[:, :d] @ wts)
    return phi, fx


def brute_force_shap(x: np.ndarray, model: dict) -> np.ndarray:
    """Exact Shapley values of the same game by subset enumeration (tests;
    exponential in the number of features)."""
    from itertools import combinations
    p = len(x)

    def f_s(S):
        tot = 0.0
        for v, feats in model["leaves"]:
            w = 1.0
            for f, (z, conds) in feats.items():
                if f in S:
                    ok = all((x[f] <= t) if gl else (x[f] > t) for t, gl in conds)
                    w *= 1.0 if ok else 0.0
                else:
                    w *= z
            tot += v * w
        return tot

    phi = np.zeros(p)
    for i in range(p):
        others = [j for j in range(p) if j != i]
        for k in range(p):
            wk = math.factorial(k) * math.factorial(p - 1 - k) / math.factorial(p)
            for S in combinations(others, k):
                phi[i] += wk * (f_s(set(S) | {i}) - f_s(set(S)))
    return phi


def shap_values(df: DataFrame, model: dict, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long table ``keys, feature, value, phi, base_value, margin``
    computed per Arrow batch on the executors."""
    feats = list(features)
    key_fields = [df.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    schema += ", feature string, value double, phi double, base_value double, margin double"

    def run(it):
        for pdf in it:
            X = pdf[feats].to_numpy(dtype="float64")
            phi, fx = shap_matrix(X, model)
            n, p = X.shape
            out = pd.DataFrame({k: np.repeat(pdf[k].to_numpy(), p) for k in keys})
            out["feature"] = np.tile(np.array(feats, dtype=object), n)
            out["value"] = X.reshape(-1)
            out["phi"] = phi.reshape(-1)
            out["base_value"] = model["base"]
            out["margin"] = np.repeat(fx, p)
            yield out

    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in feats]).mapInPandas(run, schema)


def importance(long: DataFrame) -> DataFrame:
    """Mean |phi| per feature, sorted."""
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")).orderBy(
        F.col("mean_abs_phi").desc())


def by_value(long: DataFrame, bins: int = 10) -> DataFrame:
    """Beeswarm content (M17): per feature, equal-width value bins with the
    mean attribution and row count."""
    rng = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(
        F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    ).otherwise(F.lit(0)).cast("int")
    j = long.join(F.broadcast(rng), "feature").withColumn("bin", b)
    return j.groupBy("feature", "bin").agg(F.avg("value").alias("mean_value"), F.avg("phi").alias("mean_phi"),
                                           F.count(F.lit(1)).alias("rows"))


def dependence(long: DataFrame, keys: Sequence[str], feature: str, bins: int = 10) -> DataFrame:
    """Dependence table (M18): bins of ``feature``'s value with its mean
    phi, plus the interaction feature chosen as the one whose value has the
    largest summed within-bin |corr| with ``feature``'s phi, and that
    feature's mean value per bin."""
    tgt = long.where(F.col("feature") == feature).select(*keys, F.col("value").alias("tv"), F.col("phi").alias("tphi"))
    lo_hi = tgt.agg(F.min("tv").alias("lo"), F.max("tv").alias("hi"))
    lo, hi = lo_hi.select("lo").scalar(), lo_hi.select("hi").scalar()
    b = F.when(hi > lo, F.least(F.floor((F.col("tv") - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    tgt = tgt.withColumn("bin", b.cast("int"))
    others = long.where(F.col("feature") != feature).select(*keys, "feature", "value")
    j = tgt.join(others, list(keys))
    corr = j.groupBy("feature", "bin").agg(pearson("tphi", "value").alias("c"))
    score = corr.groupBy("feature").agg(F.sum(F.abs(F.coalesce("c", F.lit(0.0)))).alias("s"))
    inter = score.orderBy(F.col("s").desc(), "feature").select("feature").limit(1).scalar()
    per_bin = j.where(F.col("feature") == inter).groupBy("bin").agg(
        F.avg("tv").alias("mean_value"), F.avg("tphi").alias("mean_phi"),
        F.avg("value").alias("interaction_mean_value"), F.count(F.lit(1)).alias("rows"))
    return per_bin.select(F.lit(feature).alias("feature"), "bin", "mean_value", "mean_phi",
                          inter.alias("interaction_feature"), "interaction_mean_value", "rows")


def top_features(long: DataFrame, keys: Sequence[str], n: int = 6) -> DataFrame:
    """Top-n features by |phi| per explained row with the base value (W5,
    M19); the window partition is one row's features (bounded by p)."""
    w = Window.partitionBy(*keys).orderBy(F.abs("phi").desc(), "feature")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
