"""Closure classifiers and their evaluation.

The two boosted models are second-order histogram boosting
(:mod:`closurelens.operators.boosting`): trees by level with positives weighted
neg / pos, and trees by leaf with balanced classes.  The random forest is
Spark's, with a weight column.  Metrics are the exact operators of
:mod:`closurelens.operators.metrics`."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import boosting as bo
from . import metrics as mt


def fill_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Model input: features filled with 0 (the reference's ``fillna(0)``)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})


def with_weights(df: DataFrame, label: str, scheme: str, name: str = "weight") -> DataFrame:
    """Class weights (A19) from label counts (scalar subqueries, one pass):
    ``balanced``: n / (2 n_class); ``pos_ratio``: neg/pos on positives."""
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    pos = df.select(F.sum(F.col(label)).cast("double")).scalar()
    neg = n - pos
    y = F.col(label) == 1
    if scheme == "balanced":
        w = F.when(y, n / (2 * pos)).otherwise(n / (2 * neg))
    elif scheme == "pos_ratio":
        w = F.when(y, neg / pos).otherwise(F.lit(1.0))
    else:
        w = F.lit(1.0)
    return df.withColumn(name, w)


#: the reference's three estimators with their libraries' defaults
FOREST = {"numTrees": 100, "maxDepth": 10}
BOOSTED = {
    "Boosting-levels": bo.Settings(trees=100, depth=6, rate=0.3, l2=1.0, min_hessian=1.0, weight="pos_ratio"),
    "Boosting-leaves": bo.Settings(trees=100, depth=0, leaves=31, rate=0.1, l2=0.0, min_hessian=1e-3, min_rows=20,
                                   weight="balanced"),
}


def fit_forest(train: DataFrame, features: Sequence[str], label: str, params: Mapping, seed: int = 42) -> PipelineModel:
    w = with_weights(train, label, "balanced")
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", seed=seed).setParams(**params)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(w)


def scores(model: PipelineModel | bo.BoostedModel, df: DataFrame) -> DataFrame:
    """Predictions with ``p1`` = P(class 1)."""
    if isinstance(model, bo.BoostedModel):
        return bo.score(model, df)
    return model.transform(df).withColumn("p1", vector_to_array("probability")[1])


def evaluate(pred: DataFrame, label: str, name: str) -> DataFrame:
    """Recall, precision, F1 of class 1 and exact PR-AUC / ROC-AUC."""
    rep = mt.class_report(pred, label, "prediction").where(F.col("class") == "1")
    auc = mt.roc_auc(pred, label, "p1").select("roc_auc").scalar()
    ap = mt.average_precision(pred, label, "p1").select("average_precision").scalar()
    return rep.select(F.lit(name).alias("model"), F.col("recall"), F.col("precision"), F.col("f1"),
                      F.round(ap, 6).alias("pr_auc"), F.round(auc, 6).alias("roc_auc"))


def compare(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, forest: Mapping = FOREST,
            boosted: Mapping[str, bo.Settings] = BOOSTED, seed: int = 42) -> DataFrame:
    """Fits the forest and the boosted models, the latter together, and evaluates each
    on the test split."""
    fitted = {"RandomForest": fit_forest(train, features, label, forest, seed)}
    fitted |= zip(boosted, bo.Boosting(train, features, label, seed=seed).fit(list(boosted.values())))
    # each score is computed once for its three metrics
    rated = [evaluate(materialize(scores(m, test).select(label, "prediction", "p1"), "scores"), label, n)
             for n, m in fitted.items()]
    return reduce(DataFrame.unionByName, rated)


#: search space of the reference's tuner
TRIALS = 50
SEARCH_SPACE = {"depth": (3, 10), "rate": (0.01, 0.3), "trees": (100, 1000), "subsample": (0.6, 1.0), "colsample": (0.6, 1.0)}


def sample_settings(n_trials: int, seed: int = 42, space: Mapping = SEARCH_SPACE) -> list[bo.Settings]:
    """Seeded random search (M12; the reference's TPE sampler is not available):
    integers uniform, rate log-uniform, fractions uniform."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_trials):
        lo, hi = space["rate"]
        out.append(bo.Settings(
            depth=int(rng.integers(space["depth"][0], space["depth"][1] + 1)),
            rate=float(math.exp(rng.uniform(math.log(lo), math.log(hi)))),
            trees=int(rng.integers(space["trees"][0], space["trees"][1] + 1)),
            subsample=float(rng.uniform(*space["subsample"])), colsample=float(rng.uniform(*space["colsample"]))))
    return out


def random_search(train: DataFrame, features: Sequence[str], label: str, fold_col: str, n_trials: int = TRIALS,
                  seed: int = 42, space: Mapping = SEARCH_SPACE) -> tuple[DataFrame, bo.Settings]:
    """k-fold cross-validated random search on ROC-AUC with the stratified fold column
    (M12, M13).  All trials and folds grow together on one binned table.  Returns
    (trial table, best settings: highest mean AUC, first trial among equal ones)."""
    spark = train.sparkSession
    trials = sample_settings(n_trials, seed, space)
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect() if r[0] is not None)
    runs = [replace(t, hold=f) for t in trials for f in folds]
    auc = bo.Boosting(train, features, label, fold_col, seed=seed).held_out_auc(runs)
    mean = {r.trial: r.auc for r in auc.groupBy(F.floor(F.col("model") / len(folds)).alias("trial")).agg(
        F.avg("auc").alias("auc")).collect()}
    rows = [(i, t.depth, t.rate, t.trees, t.subsample, t.colsample, mean.get(i)) for i, t in enumerate(trials)]
    table = spark.createDataFrame(rows, "trial int, max_depth int, step_size double, trees int, subsample double, "
                                        "colsample double, mean_auc double")
    return table, max(enumerate(trials), key=lambda x: (mean.get(x[0]) or 0.0, -x[0]))[1]


def importances(model: bo.BoostedModel, spark: SparkSession) -> DataFrame:
    """Feature importances of the fitted trees, sorted (M15): the mean gain of a
    feature's cuts, as shares."""
    return spark.createDataFrame(list(model.importances().items()), "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")
