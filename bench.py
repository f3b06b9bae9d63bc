"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then ``RUNS`` times into a sink that reads every column; the
median counts. Searches run over a stored index, which is written before (``index_sec``); ``pages_per_sec``
is the rate of writing it, ``queries_per_sec`` that of ranked search in a batch.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

NAMES = ("search_batch", "search_ranked", "search_substring", "corpus_stats", "index_upsert", "evict_lru", "apply_annotation_changes", "recents_replay", "ocr_enrich", "regression_report")
RUNS = 2


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from lectern.plans import derived
    from lectern.plans.queries import QUERIES, stored_index
    from lectern.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "16g", int(cores))
    began = time.time()
    stored_index(spark, sf)
    indexed, took = time.time() - began, {}
    for name in NAMES:
        times = []
        for _ in range(1 + RUNS):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(median(times[1:]), 3)
    pages, asked = derived.pages(spark, sf).count(), derived.query_table(spark, sf).count()
    out = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1], "pages": pages, "index_sec": round(indexed, 3), "pages_per_sec": round(pages / indexed), "queries_per_sec": round(asked / took["search_batch"], 1)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
