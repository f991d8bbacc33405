"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Each query runs once to warm
up and ``BENCH_RUNS`` times measured; the median counts. Results go to the ``noop``
sink, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from sievemark.catalog.queries import QUERIES
from sievemark.session import local_session

HEADLINE = [
    "prep_postings",
    "clean_postings",
    "clean_description",
    "dedup_title_desc_loc",
    "seeded_shuffle",
    "regex_multilabel",
    "parse_multilabel",
    "labels_to_subsets",
    "category_ids",
    "feature_combinations",
    "upsert_by_id",
    "cosine_topk",
    "model_comparison",
    "model_label_job",
    "text_encode_job",
    "retrieve_by_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
