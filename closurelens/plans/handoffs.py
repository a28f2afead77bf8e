"""Stage tables of the pipeline, written as versioned
parquet tables: each stage reads its inputs, writes once (S5: a new version
folder, never overwriting a table that is being read), and later stages
read the written table.  Returns {stage: path}."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..operators import cluster as cu
from ..operators import geojoin as gj
from ..operators import names as nm
from ..operators import risk as rk
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources import io
from . import domain


def _write(df, root: str, name: str, sort_keys=None) -> str:
    path = io.versioned_path(df.sparkSession, name, root)
    if sort_keys:
        io.write_sorted(df, path, sort_keys)
    else:
        df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    io.check_schema(back, df.schema)  # S7: the stored schema is the declared one
    return path


def write_stage_tables(spark: SparkSession, sf_dir: str, root: str | None = None,
                       min_brand_freq: int = 3) -> dict[str, str]:
    root = root or os.path.join(checkpoint_dir(spark), "closurelens", "stages")
    out: dict[str, str] = {}
    # merchant names -> matched establishments -> affiliation flag
    cleaned = nm.clean_names(fx.raw_names(spark, sf_dir))
    out["names_clean"] = _write(cleaned, root, "names_clean")
    cleaned = spark.read.parquet(out["names_clean"])
    final = nm.embed_ready(nm.final_names(cleaned, nm.brand_dictionary(cleaned), min_brand_freq))
    out["names_final"] = _write(final, root, "names_final")
    est, mer = fx.geo_points(spark, sf_dir, "est"), fx.geo_points(spark, sf_dir, "mer")
    best = gj.best_match(gj.best_pairs(est, mer))
    out["affiliation"] = _write(gj.affiliation_flag(est.select("id", "name"), best), root, "affiliation")
    # store panel, transactions, population, gold panel (sorted like the reference's write)
    out["store_counts"] = _write(domain.counts(spark, sf_dir), root, "store_counts")
    out["population"] = _write(domain.population_table(spark, sf_dir), root, "population")
    out["gold_panel"] = _write(domain.panel_full_plan(spark, sf_dir), root, "gold_panel",
                               ["month", "district", "dong"])
    # clusters (wide) and risk scores from the fixed score stand-in
    clusters = cu.assign(domain.cluster_input(spark, sf_dir), domain.CLUSTER_FEATURES, 4, domain.SEED,
                         keep=domain.ROW_KEY)
    out["clusters"] = _write(clusters, root, "clusters", ["cluster", "month", "district", "dong"])
    scores = domain.scored_panel(spark, sf_dir).select(*domain.ROW_KEY, "p", "risk_raw", "risk_score")
    out["risk_scores"] = _write(scores, root, "risk_scores")
    scores = spark.read.parquet(out["risk_scores"])
    out["top_dong"] = _write(rk.top_groups(scores, ["dong"]), root, "top_dong")
    out["top_area"] = _write(rk.top_groups(scores, ["district", "industry"], label="area"), root, "top_area")
    return out
