"""Report operators: null keys dropped like pandas groupby, ties broken by
key, mean of group means vs row mean from one GROUPING SETS pass, cluster
roles named by profile, min-max scaling."""


from closurelens.operators import risk as rk

COLS = "district string, dong string, industry string, risk_score double, closure_rate double, " \
       "affiliation_rate double, cluster int"
ROWS = [
    ("D1", "A", "I1", 0.9, 0.3, 0.1, 3),
    ("D1", "A", "I2", 0.7, 0.2, 0.2, 3),
    ("D1", "B", "I1", 0.8, 0.0, 0.5, 1),   # ties with A's mean (0.8)
    ("D2", None, "I1", 1.0, 0.1, 0.1, 0),  # null dong: not a group
    ("D2", "C", "I2", 0.1, 0.0, 0.05, 2),
]


def test_top_groups_nulls_and_ties(spark):
    df = spark.createDataFrame(ROWS, COLS)
    got = [(r["dong"], r["mean_risk"]) for r in rk.top_groups(df, ["dong"], n=10).collect()]
    assert got == [("A", 0.8), ("B", 0.8), ("C", 0.1)]
    lab = rk.top_groups(df, ["district", "industry"], label="area", n=1).first()
    assert lab["area"] == "D2 - I1" and lab["mean_risk"] == 1.0


def test_benchmarks_single_pass(spark):
    df = spark.createDataFrame(ROWS, COLS)
    r = rk.benchmarks(df).first()
    dongs = {"A": [0.9, 0.7], "B": [0.8], "C": [0.1]}
    exp_dong = sum(sum(v) / len(v) for v in dongs.values()) / 3
    assert abs(r["dong_mean_of_means"] - round(exp_dong, 6)) < 1e-12
    assert abs(r["row_mean"] - round(sum(x[3] for x in ROWS) / 5, 6)) < 1e-12
    ind = {"I1": [0.9, 0.8, 1.0], "I2": [0.7, 0.1]}
    assert abs(r["industry_mean_of_means"] - round(sum(sum(v) / len(v) for v in ind.values()) / 2, 6)) < 1e-12


def test_cluster_roles_by_profile(spark):
    df = spark.createDataFrame(ROWS, COLS)
    roles = {r["cluster"]: r["role"] for r in rk.cluster_roles(df, "cluster").collect()}
    # cluster 3 has the highest mean closure rate; among the rest, 2 has the lowest affiliation
    assert roles == {3: "danger", 2: "opportunity", 1: "other", 0: "other"}
    k = rk.cluster_kpi(df, "cluster").first()
    assert k["danger_closure_pct"] == 25.0 and k["opportunity_affiliation_pct"] == 5.0


def test_min_max_constant_column(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r["s"] for r in rk.min_max(df, "x", "s").collect()] == [0.0, 0.0]
    df2 = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double")
    assert sorted(r["s"] for r in rk.min_max(df2, "x", "s").collect()) == [0.0, 0.5, 1.0]
