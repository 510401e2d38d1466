"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of cores. Each
query gets one warm-up run, then the median of BENCH_RUNS (3) timed runs; one
timed run when the warm-up took longer than LONG seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskframe.plans.catalog import QUERIES  # noqa: E402
from riskframe.session import clean_up, local_session  # noqa: E402

LONG = 8.0

HEADLINE = [
    "features_instalments",
    "feature_table",
    "impute_median",
    "remove_outliers_2sided",
    "spearman_target",
    "spearman_matrix",
    "stratified_split",
    "undersample",
    "smote",
    "scale_robust",
    "roc_auc",
    "threshold_sweep",
    "train_logreg",
    "train_random_forest",
    "drift_report",
    "shap_values",
    "client_vs_population",
    "box_stats",
    "score_batch",
]


def run(query, spark, sf_dir) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    seconds = {}
    for name in names:
        times = 1 if run(QUERIES[name], spark, sf_dir) > LONG else runs
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(times)), 3)
        clean_up(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
