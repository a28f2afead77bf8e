"""Statistics operators vs numpy closed forms."""

import numpy as np

from closurelens.operators import clean, stats


def test_describe_quartiles_interpolate(spark):
    xs = [1.0, 2.0, 4.0, 8.0, 16.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = stats.describe(df, ["x"]).first()
    v = np.array([x for x in xs if x is not None])
    assert r["count"] == 5 and abs(r["std"] - v.std(ddof=1)) < 1e-12
    assert (r["q25"], r["q50"], r["q75"]) == tuple(np.percentile(v, [25, 50, 75]))


def test_vif_two_features_closed_form(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=500)
    b = 0.8 * a + rng.normal(scale=0.5, size=500)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {r["feature"]: r["vif"] for r in stats.vif(df, ["a", "b"]).collect()}
    # uncentred: VIF = 1 / (1 - R^2) of the no-intercept regression of one on the other
    r2 = (a @ b) ** 2 / ((a @ a) * (b @ b))
    assert abs(got["a"] - 1 / (1 - r2)) < 1e-9 and abs(got["b"] - 1 / (1 - r2)) < 1e-9
    df2 = spark.createDataFrame([(float(x), 2 * float(x)) for x in a], "a double, b double")
    assert all(np.isinf(r["vif"]) for r in stats.vif(df2, ["a", "b"]).collect())


def test_mode_ties_smallest_and_independent(spark):
    rows = [(1, "k1", "B", "c2"), (2, "k1", "A", "c2"), (3, "k1", "B", "c1"), (4, "k1", "A", "c1"),
            (5, "k1", "", ""), (6, "k2", "Z", "z1"), (7, "k2", None, None)]
    df = spark.createDataFrame(rows, "id long, code string, dong string, dong_code string")
    got = {r["id"]: (r["dong"], r["dong_code"]) for r in clean.mode_fill(df, "code", ["dong", "dong_code"]).collect()}
    assert got[5] == ("A", "c1") and got[7] == ("Z", "z1") and got[1] == ("B", "c2")


def test_mutual_information_independent_is_zero(spark):
    rows = [(float(i % 10), i // 10 % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y int")
    mi = stats.mutual_info(df, ["x"], "y").first()["mutual_info"]
    assert abs(mi) < 1e-9


def test_hash_sample_is_exact_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from closurelens.operators.features import hash_sample, key_hash
    df = spark.range(20000).withColumnRenamed("id", "k").repartition(7)
    got = [r["k"] for r in hash_sample(df, ["k"], 300, 42).collect()]
    exp = [r["k"] for r in df.withColumn("h", key_hash(["k"], 42)).orderBy("h", "k").limit(300).collect()]
    assert len(got) == 300 and set(got) == set(exp)


def test_sorted_write_and_schema_check(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from closurelens.sources import io
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"))
    path = str(tmp_path / "sorted")
    io.write_sorted(df, path, ["k"], partitions=4)
    back = spark.read.parquet(path)
    parts = back.withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))
    io.check_schema(back, df.schema)
    with pytest.raises(ValueError):
        io.check_schema(back.withColumnRenamed("k", "x"), df.schema)


def test_label_codes_distributed_rank(spark):
    from closurelens.operators.features import label_codes
    vals = [f"v{i:04d}" for i in range(1000)]
    rows = [(v,) for v in vals for _ in range(2)] + [(None,)]
    df = spark.createDataFrame(rows, "c string").repartition(5)
    got = {r["c"]: r["c_code"] for r in label_codes(df, ["c"]).collect()}
    assert got[None] is None
    assert all(got[v] == i for i, v in enumerate(sorted(vals)))


def test_stratified_folds_balanced(spark):
    from pyspark.sql import functions as F

    from closurelens.operators.features import stratified_folds
    rows = [(i, int(i % 7 == 0)) for i in range(20000)]
    df = spark.createDataFrame(rows, "k long, y int")
    f = stratified_folds(df, ["k"], "y", k=3, seed=42)
    counts = {(r["y"], r["fold"]): r["n"] for r in f.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    assert set(f.select("fold").distinct().toPandas()["fold"]) == {0, 1, 2}
    for y in (0, 1):
        sizes = [counts[(y, k)] for k in range(3)]
        assert max(sizes) - min(sizes) <= 1, sizes
    assert f.count() == 20000


def test_correlations_of_many_batches_with_gaps(spark):
    rng = np.random.default_rng(4)
    n = 3_000
    x = rng.normal(size=(n, 4)) + 1e6
    x[:, 1] += 0.5 * x[:, 0]
    x[:, 3] = 0.1 + 0.2  # no variation
    rows = [tuple(None if rng.random() < 0.2 else float("nan") if rng.random() < 0.05 else float(v) for v in r) for r in x]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(9)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = stats.corr_matrix(df, cols)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(before)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in out.collect()}
    v = np.array([[np.nan if t is None else t for t in r] for r in rows])
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            ok = ~np.isnan(v[:, i]) & ~np.isnan(v[:, j])
            if "d" in (a, b):
                assert got[a, b] is None
            else:
                assert abs(got[a, b] - np.corrcoef(v[ok, i], v[ok, j])[0, 1]) < 1e-9
    assert {r["corr"] for r in stats.corr_matrix(df.limit(0), cols).collect()} == {None}
    assert stats.vif(df.limit(0), cols).count() == 4


def test_quartiles_of_shared_values_and_empty_columns(spark):
    rng = np.random.default_rng(6)
    cols = {"even": rng.normal(size=4_000), "hot": np.where(rng.random(4_000) < 0.7, 2.0, rng.normal(size=4_000)),
            "few": rng.integers(0, 3, 4_000).astype(float)}
    rows = [(*(None if rng.random() < 0.1 else float(v) for v in r), None) for r in zip(*cols.values())]
    names = [*cols, "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(7)
    got = {r.feature: r for r in stats.describe(df, names).collect()}
    shares = [0.0, 0.1, 0.333, 1.0]
    more = {(r.feature, r.share): r.value for r in stats.quantiles(df, names, shares).collect()}
    for i, c in enumerate(cols):
        v = np.array([r[i] for r in rows if r[i] is not None])
        assert np.allclose([got[c].q25, got[c].q50, got[c].q75], np.percentile(v, [25, 50, 75]), rtol=0, atol=1e-12)
        assert np.allclose([more[c, p] for p in shares], np.quantile(v, shares), rtol=0, atol=1e-12)
        exact = [r["value"] for r in df.selectExpr(f"percentile({c}, 0.5) AS value").collect()]
        assert abs(got[c].q50 - exact[0]) < 1e-12
    assert got["none"]["count"] == 0 and got["none"].q50 is None


def test_correlation_with_a_constant_target_is_null(spark):
    rows = [(1, float(i), 2.0 * i if i % 3 else None, None) for i in range(40)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double")
    assert {r.feature: r["corr"] for r in stats.corr_target(df, ["a", "b", "c"], "y").collect()} == {"a": None, "b": None, "c": None}
    got = {r.feature: r["corr"] for r in stats.corr_target(df, ["a", "b", "y", "c"], "a").collect()}
    assert abs(got["a"] - 1) < 1e-12 and abs(got["b"] - 1) < 1e-12 and got["y"] is None and got["c"] is None
