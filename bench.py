"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from check import session

HEADLINE = [
    "median_mad_by_group", "success_rate_cells", "median_difference_error", "fligner_killeen", "box_summary", "histogram_summary",
    "pivot_median", "stratified_sample", "dataset_runs", "nmi", "rand_indices", "confusion", "cluster_moments", "assign_models",
    "bayes_classify", "nearest_label", "nearest_neighbors", "pairs_within", "kmeans_steps", "kmeans_over_k", "mixture_steps",
    "mixture_full", "density_clusters", "cluster_complex", "euler_curve", "merge_tree", "level_likelihood", "mdl_bits",
    "compression_ratio", "metacluster_description",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    from cumulus.plans import QUERIES

    QUERIES["cluster_sizes"](spark, sf).collect()  # start the JVM and the Python workers outside the timings
    QUERIES["raw_description"](spark, sf).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
