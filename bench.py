"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads, and
BENCH_QUERIES a comma-separated choice. One query on the smallest tables starts the
engine; then every query runs once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "adherence_by_category",
    "survey_clean",
    "value_counts",
    "design_matrix",
    "label_codes",
    "column_summaries",
    "stratified_holdout",
    "stratified_folds",
    "class_report",
    "roc_curve",
    "average_precision",
    "impute_segment",
    "oversampled_minority",
    "nearest_neighbours",
    "review_records",
    "reviews_clean",
    "page_key_words",
    "incremental_key_words",
    "attribution_summary",
    "held_out_predictions",
    "boosted_stumps",
    "lasso_closed_form",
    "nearest_neighbours_wide",
]


def main() -> None:
    from panelforge.catalog import REGISTRY
    from panelforge.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, where: str) -> float:
        start = time.perf_counter()
        REGISTRY[name].run(spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    small = os.path.join(os.path.dirname(folder), "sf0.001")
    warm = small if os.path.isdir(small) else folder
    run("adherence_by_category", warm)
    seconds = {name: round(run(name, folder), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
