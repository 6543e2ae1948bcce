"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores, BENCH_RUNS the
timed runs per query (the median counts; a slow query gets fewer, and "runs" says how many each had), BENCH_QUERIES a comma-separated choice or "all".
Each query runs once beforehand, so that class loading and code generation are not timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gaugeworks.plans.catalog import QUERIES  # noqa: E402
from gaugeworks.session import local_session  # noqa: E402

# No further run of a query starts after this many seconds.
BUDGET = 6.0
HEADLINE = (
    "usage_stats", "column_stats", "group_stats", "data_dictionary", "edge_cases", "pivot_daily_metrics", "unpivot_periods",
    "circulation_rows", "trend_fit", "moving_avg", "acf", "forecast", "corr_pearson", "corr_spearman", "corr_kendall_lineitem",
    "ttest", "anova", "mann_whitney", "kruskal", "shape", "outliers_z", "normality_ks", "benchmark_by_nation",
    "pii_redact", "pii_totals", "lexicon_sentiment", "sentiment_mix", "themes", "keyword_quotes", "intent_classify",
    "passages_metric", "knn_top5", "retrieval_means", "table_diff", "dedupe_by_hash", "anti_append", "error_summary", "op_stats",
    "rate_limit", "latest_n_per_user", "stream_op_stats", "report_overview",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(cores, shuffle_partitions=8)
    times: dict[str, float] = {}
    counts: dict[str, int] = {}
    for name in names:
        run(spark, name, folder)
        taken: list[float] = []
        while len(taken) < runs and sum(taken) < BUDGET:
            taken.append(run(spark, name, folder))
        times[name], counts[name] = round(statistics.median(taken), 4), len(taken)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = folder.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else folder, "cpus": cores, "runs": counts,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
