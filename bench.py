"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, warm, median of 3."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from commitgauge.checks.queries import QUERIES  # noqa: E402
from commitgauge.session import local_session  # noqa: E402

HEADLINE = (
    "avg_ccs_by_category", "domain_delta", "category_share_library", "category_by_year_top",
    "cumulative_net_loc", "traffic", "revisions_per_change", "revisions_per_file_change",
    "author_concentration", "gini_library_year", "author_rank", "contributor_heatmap", "trend_tests",
    "grouped_regression", "degree_centrality", "parse_predictions", "scored_predictions",
    "ccs_quartiles", "clean_labels", "gold_vs_model", "majority_vote", "line_counts", "commit_stats",
    "file_changes", "condensed_diff", "request_rows", "gold_sample", "classify_documents",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, 8, "bench")
    seconds = {}
    for name in names:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    report = {
        "metric": "sum of warm query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
