"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairlens.catalog import queries
from pairlens.session import build_session

HEADLINE = [
    "pool_mean",
    "gene_matrix",
    "align_three_last",
    "stratified_holdout_orders",
    "fc_edges",
    "network_fc",
    "roi_qc",
    "atlas_overlap",
    "moments",
    "standardize_train",
    "pca_scores",
    "block_pca",
    "cca_2x2",
    "scca",
    "roc_auc_lines",
    "average_precision_lines",
    "cv_summary",
    "topk_features",
    "edge_to_node",
    "coupling_grid_full",
    "coupling_grid_whole",
    "dual_grid",
    "dual_label_null",
    "stratified_coupling",
    "permutation_test_rows",
    "permutation_test_groups",
    "logreg_cv",
    "predictive_suite",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    fns = queries()
    # Start the JVM code paths and the Python workers once, outside the timings.
    fns["moments"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        fns[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
