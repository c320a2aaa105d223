"""Headline queries on one sample: prints one JSON line with seconds per query.

Every query starts without the tables earlier ones settled; each is run once to warm up and
timed on the next run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callsight.plans import queries as registered
from callsight.session import local_session

HEADLINE = [
    "endpoint_rollup",
    "size_stats",
    "categorize",
    "query_params",
    "schema_paths",
    "url_normalize",
    "link_extract",
    "scope_filter",
    "body_budget",
    "pacing_audit",
    "redact_log_lines",
    "redact_bodies",
    "leak_scan",
    "graphql_operations",
    "request_graph_edges",
    "diff_schema",
    "reachable_pages",
    "robots_filter",
    "technologies",
    "stream_endpoints",
]


def seconds(spark, sf: str, name: str) -> float:
    registered.forget()
    started = time.perf_counter()
    registered.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    timings = {}
    for name in names:
        seconds(spark, sf, name)
        timings[name] = round(seconds(spark, sf, name), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {"metric": "headline queries, total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(sf.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
