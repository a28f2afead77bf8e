"""Benchmark: wall time of every registered query at $BENCH_SF_DIR on
local[$BENCH_CPUS].  Each query's plan is executed to completion with the
``noop`` sink (no rows pulled to the driver).  Deterministic queries: median
of $BENCH_REPEAT warm runs (one run when the first takes over 20 s); model
queries (marked heavy) run once.  Models, the search and the attribution
table are cached within the run as in one user session: the first query
that needs them pays for training.

Prints ONE JSON line:
{"metric": "sum_query_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEAVY = {"cluster_assign", "k_sweep", "silhouette", "model_risk_scores", "kmeans_cluster_kpi",
         "incremental_append_stream", "model_compare", "tune_search", "model_result",
         "feature_importance", "model_roundtrip", "shap_values", "shap_importance", "shap_by_value",
         "shap_dependence", "shap_top_features"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from closurelens.plans import registry
    from closurelens.session import local_session

    spark = local_session(cpus)
    queries = registry.QUERIES
    names = only or list(queries)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # warm-up: JVM code paths and parquet footers
    run("panel_rates")
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            if name in HEAVY:
                times[name] = round(run(name), 3)
            else:
                first = run(name)
                runs = [first] + ([run(name) for _ in range(repeat - 1)] if first < 20 else [])
                times[name] = round(statistics.median(runs), 3)
        except Exception as ex:  # keep benchmarking the rest
            errors[name] = f"{type(ex).__name__}: {str(ex)[:200]}"
        print(f"# {name}: {times.get(name, errors.get(name))}", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "sum_query_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
           "cpus": int(cpus), "repeat": repeat}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
