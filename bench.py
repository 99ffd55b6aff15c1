"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed (the best of $BENCH_RUNS runs,
1 by default), its rows counted through the no-op sink so that every column is
computed. $BENCH_ONLY takes a comma-separated list of names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "class_counts_derived", "balanced_class_counts", "random_over_sampler_lineitem", "knn_join", "knn_join_pivot_cells",
    "edited_nearest_neighbours", "smote", "adasyn", "smote_tomek", "near_miss", "impute", "stratified_folds",
    "label_scores_multiclass", "roc_auc_one_vs_rest", "rank_sum_resamplers", "upsert_results", "recommend",
    "recommend_all_datasets", "wilcoxon_signed_rank", "general_meta_features", "statistical_meta_features", "multivariate_meta_features",
    "two_itemset", "concept_meta_features", "neighbour_distance_ratio", "cross_validate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    from lopside.session import local_session
    from lopside.suite.registry import QUERIES

    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once("class_counts")  # the session and its Python workers
    took = {}
    for name in only or HEADLINE:
        took[name] = round(min(once(name) for _ in range(runs)), 3)
        print(f"{took[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
