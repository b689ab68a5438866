"""Headline timings: one JSON line with seconds per query (results are counted, not kept)."""

from __future__ import annotations

import json
import os
import time

from assayframe.plans import registry
from assayframe.sources.session import get_session

HEADLINE = [
    "a6_fold_manifest", "b5_without_rare_elements", "c1_parse_formulas", "c2_reduced_key", "c5_fraction_matrix",
    "d4_describe", "d11_physics_tier", "e3_variant_audits", "f1_one_per_key", "f2_pair_distance", "f3_greedy_orders",
    "f3_greedy_orders_wide", "f3_greedy_suppliers", "f5_fold_dedup_arm", "g1_random_parts", "g3_data_efficiency",
    "g5_chemical_system_folds", "g8_range_extrapolation", "h6_prepared_features", "h7_fold_stats", "i5_metrics_by_group",
    "i7_fold_seed_metrics", "i9_bootstrap_ci", "k1_table_fingerprint",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    chosen = os.environ.get("BENCH_QUERIES")
    times = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        t = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
