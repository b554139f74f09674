"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query runs BENCH_RUNS times (default 3) to the end, all columns and rows, into Spark's
no-op sink; the median counts.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from strainshift.plans import catalog  # noqa: E402
from strainshift.session import local_session  # noqa: E402

HEADLINE = [
    "selection_vs_control", "selection_coef_diff", "weekly_mean_blocks", "multi_series_align",
    "control_interval_join", "control_prefix_integral", "logit_regressors", "ancova_fit",
    "random_intercept_fit", "nested_lrt", "many_model_sweep", "part_profile_ci", "sweep_profile_ci", "nested_f_test", "corr_test",
    "wls_score", "candidate_search", "profile_scan", "wild_replicates", "wild_refit",
    "bootstrap_summary", "ensemble_curves", "quantile_ci", "density_table", "corr_matrix",
    "cross_ensemble", "cross_sweep", "uniform_starts",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "12g")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(sf).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
