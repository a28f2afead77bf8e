"""TreeSHAP: exact Shapley values of the path-dependent game (vs subset
enumeration), additivity, and agreement with Spark's own margin."""

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from closurelens.operators import explain as ex
from closurelens.plans import domain


def test_treeshap_matches_brute_force_and_margin(spark, tmp_path):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(400, 4))
    y = ((X[:, 0] + 0.5 * X[:, 1] * X[:, 2] + 0.3 * rng.normal(size=400)) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, x), int(t)) for i, (x, t) in enumerate(zip(X, y))],
                               "id long, a double, b double, c double, d double, y int")
    va = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features")
    gbt = GBTClassifier(labelCol="y", maxIter=8, maxDepth=3, seed=1).fit(va.transform(df))
    path = str(tmp_path / "gbt")
    gbt.write().overwrite().save(path)
    model = ex.compile_model(ex.read_trees(spark, path), gbt.treeWeights)
    phi, fx = ex.shap_matrix(X[:20], model)
    for i in range(5):
        assert np.allclose(phi[i], ex.brute_force_shap(X[i], model), atol=1e-10)
    assert np.allclose(model["base"] + phi.sum(axis=1), fx, atol=1e-10)
    raw = gbt.transform(va.transform(df)).orderBy("id").select(vector_to_array("rawPrediction")[1].alias("m")).limit(20)
    margins = np.array([r["m"] for r in raw.collect()])
    assert np.allclose(fx, 2 * margins, atol=1e-9)
    long = ex.shap_values(df.where(F.col("id") < 50), model, ["a", "b", "c", "d"], ["id"])
    s = long.groupBy("id").agg(F.sum("phi").alias("s"), F.first("base_value").alias("b"), F.first("margin").alias("m"))
    assert all(abs(r["b"] + r["s"] - r["m"]) < 1e-9 for r in s.collect())


def test_dependence_with_equal_attributions_in_a_bin(spark):
    rows = []
    for i in range(40):
        low = i < 20
        rows += [(i, "t", float(i), 0.5 if low else float(i)), (i, "u", float(i % 7), 0.0), (i, "w", 3.0, 0.0)]
    long = spark.createDataFrame(rows, "id int, feature string, value double, phi double")
    got = {r.bin: r for r in ex.dependence(long, ["id"], "t", bins=2).collect()}
    assert got[0].mean_phi == 0.5 and got[0].rows == 20 and got[1].rows == 20
    assert {r.interaction_feature for r in got.values()} == {"u"}


def test_every_training_row_is_explained(spark, monkeypatch):
    """More training rows than the reference's sample of 5,000: the reports count each of them."""
    n, feats = 6000, ["station_rate", "visitors"]
    key = {"month": "2000-01", "district": "d", "industry": "i"}
    mf = spark.range(n + 300).select(
        *[F.lit(v).alias(k) for k, v in key.items()], F.col("id").cast("string").alias("dong"),
        (F.col("id") % 100 / 100).alias("station_rate"), (F.col("id") % 7).cast("double").alias("visitors"),
        F.when(F.col("id") < n, "train").otherwise("test").alias("split"))
    tree = {0: (0.0, 10.0, 1, 2, 0, 0.5), 1: (-1.0, 5.0, -1, -1, -1, 0.0), 2: (1.0, 5.0, -1, -1, -1, 0.0)}
    monkeypatch.setattr(domain, "_SHAP", {})
    monkeypatch.setattr(domain, "explained_model", lambda s, d: (None, "", ex.compile_model([tree], [1.0], 1.0), mf))
    monkeypatch.setattr(domain, "model_features", lambda s, d: feats)
    long = domain.shap_long(spark, "rows of this test")
    assert long.count() == n * len(feats)
    got = ex.dependence(long, domain.ROW_KEY, "station_rate").collect()
    assert sum(r.rows for r in got) == n
    assert {r.feature: r.rows for r in ex.by_value(long).groupBy("feature").agg(F.sum("rows").alias("rows")).collect()} == dict.fromkeys(feats, n)
