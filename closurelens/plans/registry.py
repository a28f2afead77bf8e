"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables (through the fixture stand-ins) and runs
one operator of SURVEY section 2 over them.  Doubles whose value depends on
summation order are rounded to 6 decimals at the output so results compare
exactly with the SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
import os as _os
import uuid as _uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import domain
from ..functions.dates import months_between_keys
from ..functions.numeric import parse_numeric
from ..operators import boosting as bo
from ..operators import clean as cl
from ..operators import cluster as cu
from ..operators import explain as ex
from ..operators import features as fe
from ..operators import geojoin as gj
from ..operators import impute, information as info, keys, panel, population
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import names as nm
from ..operators import risk as rk
from ..operators import stats as st
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources import io as sio

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


MEAS = ("tx_count", "tx_amount", "avg_ticket")

# ---------------------------------------------------------------- panel


@query("month_dim")
def q_month_dim(spark, d):
    return panel.month_dim(domain.stores(spark, d), *domain.WINDOW)


@query("months_between")
def q_months_between(spark, d):
    s = domain.stores(spark, d)
    return s.select("store_id", "open_month", "close_month",
                    months_between_keys("open_month", "close_month").alias("months_open"))


@query("panel_alive")
def q_panel_alive(spark, d):
    return panel.panel_alive(domain.stores(spark, d), *domain.WINDOW)


@query("panel_closed")
def q_panel_closed(spark, d):
    return panel.panel_closed(domain.stores(spark, d), *domain.WINDOW)


@query("panel_counts")
def q_panel_counts(spark, d):
    return domain.counts(spark, d)


@query("panel_rates")
def q_panel_rates(spark, d):
    return domain.rates_plan(spark, d)


@query("tx_monthly")
def q_tx_monthly(spark, d):
    return domain.tx_monthly_plan(spark, d)


@query("avg_ticket")
def q_avg_ticket(spark, d):
    return domain.tx_monthly_plan(spark, d).select("month", "dong", "industry", "avg_ticket")


@query("panel_tx")
def q_panel_tx(spark, d):
    return domain.panel_tx(spark, d)


@query("structural_zero")
def q_structural_zero(spark, d):
    return impute.structural_zero(domain.panel_tx(spark, d))


@query("group_mean")
def q_group_mean(spark, d):
    z = impute.with_group_means(impute.structural_zero(domain.panel_tx(spark, d)))
    return r6(z.select("month", "district", "dong", "industry",
                       *[f"mean_{m}" for m in MEAS]), *[f"mean_{m}" for m in MEAS])


@query("impute_group_mean")
def q_impute_group_mean(spark, d):
    return r6(domain.imputed(spark, d), *MEAS)


@query("impute_exclude")
def q_impute_exclude(spark, d):
    return r6(domain.cleaned(spark, d), *MEAS)


@query("impute_audit")
def q_impute_audit(spark, d):
    return impute.impute_audit(domain.imputed(spark, d))


@query("ratio_pivot")
def q_ratio_pivot(spark, d):
    lines = fx.population_lines(spark, d)
    return population.ratio_pivot(lines, ["month", "district", "dong"], fx.POPULATION_PIVOTS, "qty",
                                  extra={"spend_total": F.round(F.sum("spend"), 2)})


@query("repair_keys")
def q_repair_keys(spark, d):
    return domain.population_table(spark, d)


@query("normalize_dong")
def q_normalize_dong(spark, d):
    """X12 (listed names, anchored) and X13 (all names, idempotent) on
    Hangul dong names derived from the customer table."""
    n = fx.dong_names(spark, d)
    return n.select("id", "dong_raw", population.insert_je("dong_raw").alias("dong_targeted"),
                    population.insert_je("dong_raw", None).alias("dong_all"))


@query("panel_full")
def q_panel_full(spark, d):
    return r6(domain.panel_full_plan(spark, d), *MEAS)


@query("industry_map")
def q_industry_map(spark, d):
    """Industry-code mapping (J18): establishments joined with a code ->
    group table (a fixed-size dimension, broadcast)."""
    s = domain.stores(spark, d).withColumn("industry_code", F.split("industry", "/").getItem(0))
    m = fx.industry_map(spark)
    return (s.join(F.broadcast(m), "industry_code", "left")
            .select("store_id", "industry", "industry_code", "industry_group"))


@query("key_diff")
def q_key_diff(spark, d):
    return keys.key_diff(domain.cleaned(spark, d), domain.population_table(spark, d),
                         ["district", "dong"], "panel", "population")


# ---------------------------------------------------------------- features, stats

KEY = domain.ROW_KEY


@query("label_encode")
def q_label_encode(spark, d):
    return domain.features(spark, d).select(*KEY, "industry_code", "dong_code", "district_code")


@query("closure_label")
def q_closure_label(spark, d):
    return domain.features(spark, d).select(*KEY, "closure_rate", "closed_label")


@query("log_features")
def q_log_features(spark, d):
    return r6(domain.features(spark, d).select(*KEY, *domain.LOG_COLS), *domain.LOG_COLS)


@query("rolling_mean")
def q_rolling_mean(spark, d):
    f = fe.rolling_mean(domain.panel_full(spark, d), "affiliation_rate", ["district", "dong"],
                        ["month", "industry"], name="aff_rolling")
    return r6(f.select(*KEY, "affiliation_rate", "aff_rolling"), "aff_rolling")


@query("rolling_trend")
def q_rolling_trend(spark, d):
    return r6(domain.features(spark, d).select(*KEY, "aff_trend", "month_num"), "aff_trend")


@query("standardize")
def q_standardize(spark, d):
    cols = domain.CLUSTER_FEATURES
    z = fe.standardize(domain.cluster_input(spark, d).na.drop(subset=cols), cols)
    return r6(z.select(*KEY, *[f"{c}_z" for c in cols]), *[f"{c}_z" for c in cols])


@query("class_weights")
def q_class_weights(spark, d):
    f = domain.features(spark, d)
    y = F.col(domain.LABEL)
    row = f.agg(F.count(F.lit(1)).alias("rows"), F.sum(y).cast("long").alias("pos"))
    row = row.withColumn("neg", F.col("rows") - F.col("pos"))
    return r6(row.withColumns({
        "scale_pos_weight": F.try_divide(F.col("neg"), F.col("pos")),
        "weight_pos": F.try_divide(F.col("rows"), 2 * F.col("pos")),
        "weight_neg": F.try_divide(F.col("rows"), 2 * F.col("neg")),
    }), "scale_pos_weight", "weight_pos", "weight_neg")


@query("null_profile")
def q_null_profile(spark, d):
    return st.null_profile(domain.features(spark, d), domain.FEATURES)


RAW_CLUSTER = ["closure_rate", "affiliation_rate", "visitors", "avg_years", "avg_ticket",
               "station_rate", "spend_total"]


@query("describe")
def q_describe(spark, d):
    return r6(st.describe(domain.panel_full(spark, d), RAW_CLUSTER),
              "mean", "std", "min", "q25", "q50", "q75", "max")


@query("histogram")
def q_histogram(spark, d):
    return r6(st.histogram(domain.panel_full(spark, d), RAW_CLUSTER, 30), "bin_lo", "bin_hi")


@query("density")
def q_density(spark, d):
    return r6(st.density(domain.panel_full(spark, d), "closure_rate"), "x", "density")


@query("corr_target")
def q_corr_target(spark, d):
    return r6(st.corr_target(domain.features(spark, d), domain.FEATURES, domain.LABEL), "corr")


@query("corr_matrix")
def q_corr_matrix(spark, d):
    return r6(st.corr_matrix(domain.features(spark, d), domain.FEATURES), "corr")


@query("mutual_info")
def q_mutual_info(spark, d):
    return st.mutual_info(domain.features(spark, d), domain.FEATURES, domain.LABEL)


@query("mutual_info_quantiles")
def q_mutual_info_quantiles(spark, d):
    return info.mutual_info_quantiles(domain.features(spark, d), domain.FEATURES, domain.LABEL)


@query("mutual_info_neighbours")
def q_mutual_info_neighbours(spark, d):
    return info.mutual_info_neighbours(domain.features(spark, d), domain.FEATURES, domain.LABEL)


@query("mi_group_top")
def q_mi_group_top(spark, d):
    mi = st.mutual_info(domain.features(spark, d), domain.FEATURES, domain.LABEL)
    return st.group_top(mi, domain.FEATURE_GROUPS)


# ---------------------------------------------------------------- risk and clusters


@query("risk_score")
def q_risk_score(spark, d):
    s = domain.scored_panel(spark, d)
    return r6(s.select(*KEY, "p", "risk_raw", "risk_score"), "p", "risk_raw", "risk_score")


@query("risk_by_dong")
def q_risk_by_dong(spark, d):
    return rk.top_groups(domain.scored_panel(spark, d), ["dong"])


@query("risk_by_industry")
def q_risk_by_industry(spark, d):
    return rk.top_groups(domain.scored_panel(spark, d), ["industry"])


@query("risk_by_district_industry")
def q_risk_by_district_industry(spark, d):
    return rk.top_groups(domain.scored_panel(spark, d), ["district", "industry"], label="area")


@query("risk_benchmarks")
def q_risk_benchmarks(spark, d):
    return rk.benchmarks(domain.scored_panel(spark, d))


CLUSTER_REPORT = ["closure_rate", "affiliation_rate", "avg_years", "station_rate",
                  "spend_total_log", "visitors_log", "avg_ticket_log"]


@query("cluster_profile")
def q_cluster_profile(spark, d):
    return rk.cluster_profile(domain.clustered_panel(spark, d), "cluster", CLUSTER_REPORT)


@query("cluster_sizes")
def q_cluster_sizes(spark, d):
    return rk.cluster_sizes(domain.clustered_panel(spark, d), "cluster")


@query("cluster_kpi")
def q_cluster_kpi(spark, d):
    return rk.cluster_kpi(domain.clustered_panel(spark, d), "cluster")


@query("cluster_top_areas")
def q_cluster_top_areas(spark, d):
    s = domain.scored_panel(spark, d).withColumn("cluster", rk.rule_cluster())
    danger = rk.cluster_roles(s, "cluster").where(F.col("role") == "danger")
    return rk.top_groups(danger, ["dong"])


# ---------------------------------------------------------------- sources, cleaning, metrics


STUDY_START, STUDY_END = "2000-01-01 00:00:00", "2001-09-30 00:00:00"


@query("scan_not_null")
def q_scan_not_null(spark, d):
    domain.stores(spark, d).createOrReplaceTempView("cl_stores")
    return spark.sql("SELECT store_id AS uid, dong, close_month FROM cl_stores WHERE close_month IS NOT NULL")


@query("csv_roundtrip")
def q_csv_roundtrip(spark, d):
    path = _os.path.join(checkpoint_dir(spark), "closurelens", f"csv-{_uuid.uuid4().hex}")
    return sio.csv_roundtrip(domain.rates(spark, d), path)


@query("parse_numeric")
def q_parse_numeric(spark, d):
    t = fx.text_numbers(spark, d)
    return t.withColumn("amount", parse_numeric("amount_text"))


def _licences_window(spark, d):
    lic = fx.licences(spark, d).withColumn("close_date", cl.lenient_timestamp("close_text"))
    return cl.study_window(lic, "open_date", "close_date", STUDY_START, STUDY_END)


def _datestr(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


@query("study_window_filter")
def q_study_window_filter(spark, d):
    return _datestr(_licences_window(spark, d), "open_date", "close_date")


@query("drop_incomplete")
def q_drop_incomplete(spark, d):
    lic = fx.licences(spark, d).withColumn("close_date", cl.lenient_timestamp("close_text"))
    out = cl.drop_incomplete(lic, ["open_date", "close_date"], blank_fill=["close_text"])
    return _datestr(out, "open_date", "close_date")


@query("mode_fill")
def q_mode_fill(spark, d):
    return cl.mode_fill(fx.mode_src(spark, d), "legal_dong_code", ["dong", "dong_code"])


@query("json_flatten")
def q_json_flatten(spark, d):
    return sio.json_flatten(fx.json_src(spark, d), "response",
                            "k INT, text STRING, level1 STRING, level2 STRING")


def _scored(spark, d):
    return fx.scored(spark, d).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


@query("confusion")
def q_confusion(spark, d):
    return mt.confusion(_scored(spark, d))


@query("class_report")
def q_class_report(spark, d):
    return mt.class_report(_scored(spark, d))


@query("roc_auc")
def q_roc_auc(spark, d):
    return r6(mt.roc_auc(_scored(spark, d)), "roc_auc")


@query("average_precision")
def q_average_precision(spark, d):
    return r6(mt.average_precision(_scored(spark, d)), "average_precision")


# ---------------------------------------------------------------- merchant names

# frequency threshold for brands among HOLD rows on the fixture (the
# reference's 500 presumes a city-sized merchant table)
MIN_BRAND_FREQ = 3


def _cleaned(spark, d):
    """First-pass names written once to the shared folder: three branches
    read them, and predicates on the result are not pushed into (and do not
    duplicate) the regex chain."""
    return domain._gold("names-clean", d, lambda: nm.clean_names(fx.raw_names(spark, d)), spark=spark)


@query("names_clean")
def q_names_clean(spark, d):
    return nm.clean_names(fx.raw_names(spark, d))


@query("names_vocab")
def q_names_vocab(spark, d):
    return nm.vocabulary(_cleaned(spark, d))


@query("brand_extract")
def q_brand_extract(spark, d):
    c = _cleaned(spark, d)
    return nm.resolve_hold(c, nm.brand_dictionary(c), MIN_BRAND_FREQ)


@query("names_final")
def q_names_final(spark, d):
    c = _cleaned(spark, d)
    return nm.final_names(c, nm.brand_dictionary(c), MIN_BRAND_FREQ)


@query("names_embed_ready")
def q_names_embed_ready(spark, d):
    c = _cleaned(spark, d)
    return nm.embed_ready(nm.final_names(c, nm.brand_dictionary(c), MIN_BRAND_FREQ))


# ---------------------------------------------------------------- spatial and fuzzy joins

def _geo(spark, d):
    return fx.geo_points(spark, d, "est"), fx.geo_points(spark, d, "mer")


def _match_cols(df):
    return r6(df, "distance_m", "similarity_score")


@query("haversine")
def q_haversine(spark, d):
    est, mer = (side.select("id", "lat", "lon") for side in _geo(spark, d))
    p = gj.within_distance(est, mer, 100.0, left_prefix="e_", right_prefix="m_", columns=["id"], digits=6)
    return p.select("e_id", "m_id", "distance_m")


@query("name_similarity")
def q_name_similarity(spark, d):
    est, mer = _geo(spark, d)
    # rounded where it is measured: once for the rows of one name and place that meet those of another
    similarity = F.round(gj.name_similarity("e_name", "m_name"), 6)
    p = gj.within_distance(est, mer, 100.0, left_prefix="e_", right_prefix="m_", by=["name"], columns=["id"],
                           add={"similarity_score": similarity})
    return p.select("e_id", "m_id", "e_name", "m_name", "similarity_score")


@query("fuzzy_geo_match")
def q_fuzzy_geo_match(spark, d):
    est, mer = _geo(spark, d)
    return _match_cols(gj.fuzzy_geo_match(est, mer))


@query("best_match")
def q_best_match(spark, d):
    return _match_cols(gj.best_match(domain.matched_pairs(spark, d)))


@query("affiliation_flag")
def q_affiliation_flag(spark, d):
    est, _ = _geo(spark, d)
    best = gj.best_match(domain.matched_pairs(spark, d))
    return gj.affiliation_flag(est.select("id", "name"), best)


@query("near_station")
def q_near_station(spark, d):
    return r6(gj.near_flag(fx.est_points(spark, d), fx.stations(spark, d), fx.STATION_RADIUS_M),
              "lat", "lon")


@query("reverse_geocode")
def q_reverse_geocode(spark, d):
    out = gj.nearest(fx.est_points(spark, d), fx.stations(spark, d))
    return r6(out, "lat", "lon", "distance_m")


# ---------------------------------------------------------------- samples, folds, persistence
@query("hash_sample")
def q_hash_sample(spark, d):
    return fe.hash_sample(domain.features(spark, d), KEY, 5000, domain.SEED).select(*KEY, domain.LABEL)


@query("hash_split")
def q_hash_split(spark, d):
    return fe.hash_split(domain.features(spark, d), KEY, domain.SEED).select(*KEY, domain.LABEL, "split")


@query("stratified_folds")
def q_stratified_folds(spark, d):
    f = fe.stratified_folds(domain.features(spark, d), KEY, domain.LABEL, 3, domain.SEED)
    return f.select(*KEY, domain.LABEL, "fold")


@query("incremental_append")
def q_incremental_append(spark, d):
    """Geocoded points appended in two overlapping batches, the second one
    repeated: the stored table holds every point exactly once."""
    pts = gj.nearest(fx.est_points(spark, d), fx.stations(spark, d))
    path = sio.versioned_path(spark, "geocoded")
    first = pts.where(F.col("id") % 2 == 0)
    sio.incremental_append(first, path, "id")
    sio.incremental_append(pts, path, "id")
    sio.incremental_append(pts, path, "id")
    return r6(sio.read_incremental(spark, path), "lat", "lon", "distance_m")


@query("model_roundtrip")
def q_model_roundtrip(spark, d):
    _, path, _, mf = domain.explained_model(spark, d)
    loaded = bo.BoostedModel.load(spark, path)
    return md.scores(loaded, mf.where("split = 'test'")).select(*KEY, domain.LABEL, "prediction", "p1")


# ---------------------------------------------------------------- clustering and models


@query("cluster_assign")
def q_cluster_assign(spark, d):
    _, pred = domain.kmeans_clusters(spark, d)
    return pred.drop("features")


@query("k_sweep")
def q_k_sweep(spark, d):
    return cu.k_sweep(domain.cluster_input(spark, d), domain.CLUSTER_FEATURES, range(2, 11), domain.SEED)


@query("silhouette")
def q_silhouette(spark, d):
    _, pred = domain.kmeans_clusters(spark, d)
    return spark.createDataFrame([(4, cu.silhouette(pred))], "k int, silhouette double")


@query("vif")
def q_vif(spark, d):
    return st.vif(md.fill_features(domain.features(spark, d), domain.FEATURES), domain.FEATURES)


@query("model_compare")
def q_model_compare(spark, d):
    mf = domain.model_frame(spark, d)
    return md.compare(mf.where("split = 'train'"), mf.where("split = 'test'"), domain.model_features(spark, d),
                      domain.LABEL)


@query("tune_search")
def q_tune_search(spark, d):
    table, _ = domain.search(spark, d)
    return table


@query("model_result")
def q_model_result(spark, d):
    """The tuned model (best search parameters, refitted on train)
    evaluated on the test split (M14)."""
    m, _, _, mf = domain.explained_model(spark, d)
    return md.evaluate(md.scores(m, mf.where("split = 'test'")), domain.LABEL, "Boosting tuned")


@query("feature_importance")
def q_feature_importance(spark, d):
    m, _, _, _ = domain.explained_model(spark, d)
    return md.importances(m, spark)


# ---------------------------------------------------------------- attributions


@query("shap_values")
def q_shap_values(spark, d):
    return domain.shap_long(spark, d)


@query("shap_importance")
def q_shap_importance(spark, d):
    return ex.importance(domain.shap_long(spark, d))


@query("shap_by_value")
def q_shap_by_value(spark, d):
    return ex.by_value(domain.shap_long(spark, d))


@query("shap_dependence")
def q_shap_dependence(spark, d):
    return ex.dependence(domain.shap_long(spark, d), KEY, "station_rate")


@query("shap_top_features")
def q_shap_top_features(spark, d):
    return ex.top_features(domain.shap_long(spark, d), KEY, 6)


@query("model_risk_scores")
def q_model_risk_scores(spark, d):
    """M20 + M21 as the reference runs them: the fitted boosted model scores
    every panel row, and its probability enters the weighted risk index."""
    m, _, _, _ = domain.explained_model(spark, d)
    feats = md.fill_features(domain.features(spark, d), domain.model_features(spark, d))
    scored = md.scores(m, feats).select(*KEY, domain.LABEL, "affiliation_rate", "visitors", "station_rate",
                                        F.col("p1").alias("p"))
    return rk.risk_score(scored, "p").select(*KEY, domain.LABEL, "p", "risk_raw", "risk_score")


@query("kmeans_cluster_kpi")
def q_kmeans_cluster_kpi(spark, d):
    """Cluster KPIs (A12) on the k-means clusters (M2) instead of rule ids."""
    _, pred = domain.kmeans_clusters(spark, d)
    return rk.cluster_kpi(pred.drop("features"), "cluster")


@query("incremental_append_stream")
def q_incremental_append_stream(spark, d):
    """S6 as a stream: points land as parquet files in two overlapping
    rounds; a foreachBatch query (trigger availableNow) geocodes each
    micro-batch and appends only new keys.  Every point is stored once."""
    import os

    from ..streaming.incremental import start_incremental
    pts = fx.est_points(spark, d)
    stations = fx.stations(spark, d)
    base = sio.versioned_path(spark, "geocode-stream")
    src, out, ck = (os.path.join(base, x) for x in ("landing", "table", "checkpoint"))
    pts.where(F.col("id") % 2 == 0).write.mode("append").parquet(src)

    def geocode(batch):
        return gj.nearest(batch, stations)

    for _ in range(2):
        start_incremental(spark.readStream.schema(pts.schema).parquet(src), out, "id", ck,
                          geocode).awaitTermination()
        pts.write.mode("append").parquet(src)
    start_incremental(spark.readStream.schema(pts.schema).parquet(src), out, "id", ck,
                      geocode).awaitTermination()
    return r6(sio.read_incremental(spark, out), "lat", "lon", "distance_m")
