"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and then up to three times into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from flowcairn.catalog import QUERIES
from flowcairn.catalog.bindings import event_features
from flowcairn.plans.models import train_model
from flowcairn.session import local_session

HEADLINE = [
    "flow_ratios", "ratio_validation", "fusion_class_dist", "harmonized_fusion", "class_distribution", "column_stats",
    "corr_pairs", "sanitize_clip", "median_impute", "robust_scale", "standard_scale", "label_encode", "stratified_split",
    "stratified_kfold", "sample_exact", "mutual_information", "ks_two_sample", "feature_similarity", "kde_by_label",
    "roc_auc", "fold_metrics", "knn_classify", "topsis_parts", "decision_rank", "pareto_front", "flow_assembly",
    "flow_sessions", "smote",
]
TRAINING = {
    "LR": {},
    "DT": {"max_depth": 10},
    "RF": {"n_estimators": 100, "max_depth": 10},
    "CNN": {"epochs": 20},
}
LONG_RUN = 20.0  # seconds; such a query is measured once


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench", os.environ.get("BENCH_MEMORY", "12g"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    seconds: dict[str, float] = {}

    def measure(name, run):
        first = timed(run)
        times = [first] if first > LONG_RUN else [timed(run) for _ in range(repeats)]
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)

    for name in HEADLINE:
        measure(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    events, features = event_features(spark, sf_dir)
    events = events.na.fill(0.0).persist()
    events.count()
    for name, params in TRAINING.items():
        measure(f"train_{name}", lambda: train_model(name, events, features, params=params))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
