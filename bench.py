"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query is computed in
full into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "numeric_summary", "missing_counts", "segment_value_counts", "document_length_profile",
    "mean_imputed", "median_imputed", "outliers_removed", "first_of_duplicates", "column_moved_up", "orders_in_period",
    "calendar_features", "label_encoded", "one_hot_columns", "minmax_scaled", "standard_scaled", "robust_scaled",
    "polynomial_degree_2", "softmax_per_user", "shifted_grid", "matrix_standardized",
    "word_counts", "vocabulary", "text_sequences", "padded_front",
    "windows_per_user", "window_with_horizon", "value_ahead",
    "shuffled_split", "stratified_split", "folds", "oversampled_to_targets", "augmented_with_draws", "smote_points",
    "nearest_neighbours", "r_squared", "f1_macro", "roc_auc", "roc_auc_with_ties",
    "ranked_by_score", "top_three_per_group", "running_total",
    "principal_axes", "discriminant_axes", "linear_fit", "gradient_boosting", "kmeans_as_classes",
    "grid_search", "halving_grid_search", "event_value_regression", "text_quality_classifier",
]


def main() -> None:
    from mlframe.plans import QUERIES
    from mlframe.session import get_session, release_scratch

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["column_function_pandas"](spark, folder).write.format("noop").mode("overwrite").save()  # start the workers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        release_scratch(spark)
    ratio = {}
    if "grid_search" in seconds and "halving_grid_search" in seconds:
        ratio["grid_over_halving"] = round(seconds["grid_search"] / seconds["halving_grid_search"], 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), **ratio}))


if __name__ == "__main__":
    main()
