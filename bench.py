"""Time every registered query; one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ONLY (comma-separated names) choose what runs. Each query runs twice in one
session: the first run pays for planning and compiling new code, the second is
what ``queries`` and ``value`` report. ``first_run_total`` is the sum of the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tideline.plans import all_queries
from tideline.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cpus, "tideline-bench")
    queries = {n: f for n, f in all_queries().items() if not only or n in only}

    def timed(fn) -> float:
        started = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 4)

    first, seconds = {}, {}
    for name, fn in queries.items():
        first[name] = timed(fn)
        seconds[name] = timed(fn)
        print(f"{name}: {first[name]}s, then {seconds[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "first_run_total": round(sum(first.values()), 4),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
