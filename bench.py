"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line with per-query seconds.  Each
query is forced with a ``noop`` write, so every column is computed (a
``count()`` would let Catalyst prune the work away).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "source_counts",        # flagship: clean -> length -> exact dedup -> per source
    "process_texts",
    "survey_combined",
    "combine_sources",
    "near_dup_pairs",
    "dedup_full",
    "build_clean",
    "tag_dist_code",
    "class_weights",
    "split_rarest",
    "split_iterative",
    "label_counts",
    "split_categories",
    "split_export",
    "rank_threshold_tags",
    "metrics_suite",
    "metrics_per_label",
    "evaluate",
    "score_batch",
    "stream_tag",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from tagweave.plans.catalog import QUERIES
    from tagweave.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app_name="tagweave-bench")
    # warm-up: JVM, codegen caches and Python workers
    QUERIES["tag_dist_code"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf_label = os.path.basename(os.path.normpath(sf)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_label}))
    spark.stop()


if __name__ == "__main__":
    main()
