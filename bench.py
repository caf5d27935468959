"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query is planned and
run in full into a sink that drops the rows, once after a warm-up run of the session. Those
of at most WARM_BELOW seconds run once more, as `warm`. `rows_per_sec` are rows of the
largest table that a query reads, by its better run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from channel_signals.session import get_spark
from channel_signals.workload.spark_queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "build_features", "avg_title_similarity_docs", "type_token_ratio", "opening_repeat_ratio",
    "upload_cadence_events", "upload_intervals", "upload_burst_ratio", "interval_anomaly",
    "correlation_matrix", "class_stats", "boxplot_stats", "histogram", "kde", "roc_auc",
    "average_precision", "stratified_folds", "parse_channel_refs", "json_uploads_roundtrip",
    "curate_quota", "language_profiles", "language_identify", "feature_correlation", "score_batch",
    "features_bucketed", "language_bayes", "sketch_quantiles", "keyed_ingest", "stream_first_seen",
    "stream_late_uploads", "compare_models",
]
#: The table whose rows a query is rated by.
RATED = {
    "build_features": "documents", "avg_title_similarity_docs": "documents", "features_bucketed": "documents",
    "upload_cadence_events": "events", "upload_intervals": "orders", "interval_anomaly": "orders",
    "class_stats": "lineitem", "boxplot_stats": "lineitem", "correlation_matrix": "lineitem", "sketch_quantiles": "lineitem",
    "keyed_ingest": "orders", "stream_first_seen": "orders", "language_identify": "documents", "language_bayes": "documents",
}
WARM_BELOW = 10


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", cores=CPUS)
    run(spark, "upload_cadence_events")
    seconds, warm = {}, {}
    for name in names:
        seconds[name] = run(spark, name)
        if seconds[name] <= WARM_BELOW:
            warm[name] = run(spark, name)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    counts = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in {RATED[n] for n in names if n in RATED}}
    rates = {n: round(counts[RATED[n]] / min(s, warm.get(n, s))) for n, s in seconds.items() if n in RATED}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "warm": warm, "rows_per_sec": rates, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }), flush=True)


if __name__ == "__main__":
    main()
