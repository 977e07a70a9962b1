"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from fieldlab.plans import REGISTRY

HEADLINE = [
    "scan_time_slice", "select_time_ranges", "even_subsample", "stats_abs", "stats_train_ranges", "stats_diff", "normalize",
    "compose_phase", "prior_lag", "asof_nearest", "asof_unbounded", "pair_cross_source", "corrupt_blur", "corrupt_noise",
    "corrupt_patch_shuffle", "corrupt_rotation", "disturb_replace", "psd_2d", "psd_radial", "psd_histogram", "balanced_epoch",
    "mask_targets", "mask_context", "extract_features", "covariance", "frechet", "mmd_rbf", "logits_by_lead", "reverse_kl_by_lead",
    "percentile_limits", "probe_metrics", "kfold_pools",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldlab-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executor threads before the clock
    times = {}
    for name in names:
        start = time.time()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    result = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}
    print(json.dumps({**result, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
