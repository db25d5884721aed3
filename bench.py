"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from lodestat.plans import registry
from lodestat.session import build_session

HEADLINE = [
    "b5_numeric_summary",
    "b10_top_values",
    "b15_profile_table",
    "c13_readiness_report",
    "d12_select_k_best_classification",
    "e1_detect_frequency_raw",
    "e9_acf",
    "e16_profile_series",
    "f6_rolling_features",
    "g1_forecast_sma",
    "g3_forecast_arima",
    "g5_forecast_ets",
    "h2_classification_metrics",
    "h8_evaluate_forecast",
    "h9_silhouette_squared",
    "i3_fit_linear",
    "i8_knn_predict",
    "k2_kmeans_sweep",
    "k4_dbscan",
    "l2_linear_attribution",
    "m1_score_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_catalog()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("count(l_orderkey)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
