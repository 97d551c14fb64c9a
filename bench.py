"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from memjoin.plans import load_all
from memjoin.session import local_session

HEADLINE = [
    "j4_idf_token_scores",
    "j1_exact_vector_topk",
    "j1_text_vector_topk",
    "j11_four_source_merge",
    "j21_token_field_scores",
    "j24_associative_recall",
    "j9_metadata_graph",
    "w2_token_budget_packing",
    "a23_ranked_metrics",
    "a5_metric_rollup",
    "f21_rule_field_extraction",
    "t2_memory_state_fold",
    "j19_collision_candidates",
    "j22_hybrid_vector_token",
    "j34_basin_descent",
    "relevance_verbatim",
    "a6_bootstrap_ci",
    "p11_retrieval_pair_rows",
    "s3_sanitize_and_slice",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "memjoin-bench")
    registry = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        started = time.time()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
