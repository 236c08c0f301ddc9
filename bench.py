"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is fully
executed through the ``noop`` sink (every row computed, nothing collected to
the driver); the reported time per query is the best of ``$BENCH_REPEAT``
runs (default 2) after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "analytics_kpis",
    "trend_hour",
    "top_error_groups",
    "status_distribution",
    "related_errors",
    "redact_documents",
    "mask_secrets_documents",
    "render_jsend",
    "error_occurrences",
    "breaker_fold",
    "retry_outcomes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from faultline.plans.registry import QUERIES, load_all
    from faultline.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="faultline-bench")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # warm the JVM

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        best = None
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as e:  # keep measuring the others; report the failure
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else None,
                "cpus": cpus,
                **({"failed": failed} if failed else {}),
            }
        )
    )


if __name__ == "__main__":
    main()
