"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ldpspark.session import local_session
from workload import load

HEADLINE = (
    "uniform_keyed",
    "exact_split",
    "batch_assign",
    "minmax",
    "mean_impute",
    "ordinal_encode_many",
    "pm_perturb",
    "pm_multi",
    "de_strict",
    "qm_sample",
    "qm_argmax",
    "qm_by_budget",
    "mech_sweep",
    "mech_audit",
    "linear_gd",
    "linear_minibatch",
    "logistic_gd",
    "softmax_gd",
    "softmax_wide",
    "grid_train",
    "auc",
    "youden",
    "macro_auc",
    "privacy_grid_pm",
    "privacy_grid_qm",
    "run_store",
    "compare_linear",
    "compare_logistic",
    "compare_softmax",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    # start the JVM's first job before the clock
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
