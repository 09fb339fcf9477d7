"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local cores.
Every query is run to the end, results thrown away; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from siterank.catalog import QUERIES, index_documents
from siterank.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "page_records",
    "page_links",
    "selected_documents",
    "zscores",
    "in_links",
    "document_postings",
    "bm25_topn",
    "phrase_match",
    "search_snippets",
    "query_expand",
    "impressions_by_domain",
    "latency_running_mean",
    "stream_clicks",
]


def run_query(name: str):
    def run(spark):
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    return run


def main() -> None:
    spark = build_session(
        "siterank-bench",
        f"local[{CPUS}]",
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="siterank-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: run_query(name) for name in HEADLINE}
    jobs["index_documents"] = lambda s: index_documents(s, SF_DIR)
    times: dict[str, float] = {}
    for name, job in jobs.items():
        for _ in range(RUNS):
            start = time.perf_counter()
            job(spark)
            seconds = time.perf_counter() - start
            times[name] = round(min(seconds, times.get(name, seconds)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )


if __name__ == "__main__":
    main()
