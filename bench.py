"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weirlog.plans.catalog import QUERIES  # noqa: E402
from weirlog.session import local_session  # noqa: E402

HEADLINE = (
    "service_levels",
    "syslog_records",
    "http_records",
    "sequence",
    "segment",
    "segment_small",
    "throughput_by_count",
    "render_message",
    "archive_gz",
    "stream_syslog",
)
REPEATS = 2


def seconds(spark, name: str, sf_dir: str) -> float:
    """Time to plan a query and produce every row of it."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus), **{"spark.python.sql.dataFrameDebugging.enabled": "false"})
    times = {name: round(min(seconds(spark, name, sf_dir) for _ in range(REPEATS)), 3) for name in HEADLINE}
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
