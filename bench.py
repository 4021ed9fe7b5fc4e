"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from querybook import QUERIES

HEADLINE = [
    "src_csv", "infer_types", "dedup_rows", "dedup_subset", "fill_mean", "fill_median", "fill_forward", "outliers_iqr_drop",
    "text_standardize", "cast_category", "missing_values", "dup_rows", "dup_positions", "column_dups", "validator_outliers",
    "validate_all", "column_profile", "numeric_profile_e", "categorical_profile_e", "describe", "corr_pearson",
    "corr_spearman", "corr_kendall", "normality_k2", "histogram_20", "histogram_auto", "detect_patterns", "quality_score_e",
    "ml_readiness", "ts_daily", "viz_scatter", "full_report", "diff_versions", "ml_prepare", "ml_logistic", "ml_kmeans",
    "ml_dbscan", "ml_random_forest_cls", "ml_xgboost_cls", "ml_svm", "ml_svr", "ml_compare",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cores).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # the first query would otherwise pay for starting up
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    QUERIES["src_tsv"](spark, folder).count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "total seconds over the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
