"""The stand-ins over the whole driver tables at sf0.01 agree with DuckDB
(stores, closed, panel rows, imputation branches) and with the counts
FIXTURES.md measured (geo sides, match bands, matched establishments)."""

from pyspark.sql import functions as F

from closurelens.operators import geojoin as gj
from closurelens.operators import panel
from closurelens.plans import domain, oracle
from closurelens.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


def sql(query: str) -> list:
    from oracle_check import duck
    return duck(SF).execute(query).fetchall()


def test_store_panel_counts(spark):
    s = fx.stores(spark, SF)
    rows, closed = sql("SELECT count(*), count_if(o_orderstatus <> 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) FROM orders")[0]
    assert s.count() == rows and s.where(F.col("close_month").isNotNull()).count() == closed
    c = panel.panel_counts(s, fx.WINDOW_START, fx.WINDOW_END)
    want = sql(f"SELECT count(*), count_if(closed > 0), count_if(alive = 0 AND closed > 0) FROM ({oracle.SQL['panel_counts']})")[0]
    assert (c.count(), c.where("closed > 0").count(), c.where("alive = 0 AND closed > 0").count()) == want


def test_geo_counts(spark):
    est, mer = fx.geo_points(spark, SF, "est"), fx.geo_points(spark, SF, "mer")
    assert est.count() == 992 and mer.count() == 1008
    m = gj.fuzzy_geo_match(est, mer)
    hi = m.where((F.col("similarity_score") >= 0.9) & (F.col("distance_m") <= 100)).count()
    lo = m.where((F.col("similarity_score") < 0.9) & (F.col("distance_m") <= 50)).count()
    assert (hi, lo) == (547, 114)
    assert gj.best_match(m).count() == 467


def test_feature_label_counts(spark):
    f = domain.features_plan(spark, SF)
    n = sql(f"SELECT count(*) FROM ({oracle.SQL['panel_full']})")[0][0]
    assert f.count() == n and 0 < f.where("closed_label = 1").count() < n


def test_imputation_branch_counts(spark):
    from closurelens.operators import impute
    audit = {r["impute_status"]: r["rows"] for r in impute.impute_audit(domain.imputed(spark, SF)).collect()}
    assert audit == dict(sql(f"SELECT impute_status, rows FROM ({oracle.SQL['impute_audit']})"))


def test_scored_fixture_auc(spark):
    from closurelens.plans import registry
    # FIXTURES.md: 101 distinct scores with ties, ROC-AUC 0.498177
    assert fx.scored(spark, SF).select("p").distinct().count() == 101
    assert registry.QUERIES["roc_auc"](spark, SF).first()["roc_auc"] == 0.498177
