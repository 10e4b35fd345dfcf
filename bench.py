"""Time the headline queries on the driver's tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from foretally.plans import catalog, load_all

HEADLINE = (
    "split_forecast_skill", "count_split_table", "temporal_target_features", "rolling_prior",
    "history_rates", "leverage_index", "outing_workload", "workload_features", "outcome_by_groups",
    "numeric_audit", "univariate_signal", "probability_scores", "segment_platt", "metric_profiles",
    "fingerprint_matches", "stateless_features", "batch_scoring", "capped_sample",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = [a for a in sys.argv[1:] if a in catalog.CATALOG] or list(HEADLINE)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().collect()
    took = {}
    for name in names:
        start = time.perf_counter()
        catalog.CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
