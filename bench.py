"""Benchmark: run the registered queries on one scale factor and print ONE
JSON line ``{"metric", "value", "unit", "queries", "sf", ...}``.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERIES`` (comma-separated name prefixes; default all),
``BENCH_WARM`` (1 = also time a second, warm run), ``BENCH_EVENTLOG`` (a
scratch folder: write Spark's event log there for stage and task times).
Every query runs on its own, from the tables.

Each query is forced to full execution with the ``noop`` sink, so neither
result size nor driver collection is part of the time; a query's time
includes the jobs it issues itself while its plan is built (samples, writes
and counts of the ordering operators). Intermediate tables are deleted after
each query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [p for p in os.environ.get("BENCH_QUERIES", "").split(",") if p]
    warm = os.environ.get("BENCH_WARM", "0") == "1"

    from revlens.catalog import REGISTRY
    from revlens.session import build_session, clear_materialized
    from revlens.sources.adapters import load_tables

    extra = {"spark.driver.memory": "16g"}
    if os.environ.get("BENCH_EVENTLOG"):
        extra.update({"spark.eventLog.enabled": "true",
                      "spark.eventLog.dir": os.environ["BENCH_EVENTLOG"]})
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, extra=extra)
    tables = load_tables(spark, sf_dir)
    # JVM start-up and first-use class loading are not query time
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    warm_times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in REGISTRY.items():
        if only and not any(name.startswith(p) for p in only):
            continue
        for bucket in ([times, warm_times] if warm else [times]):
            t0 = time.perf_counter()
            try:
                fn(tables).write.format("noop").mode("overwrite").save()
            except Exception as ex:  # noqa: BLE001 - report and continue
                failed[name] = str(ex)[:200]
                break
            bucket[name] = round(time.perf_counter() - t0, 3)
            clear_materialized(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "n_queries": len(times),
    }
    if warm_times:
        out["warm_queries"] = warm_times
        out["warm_value"] = round(sum(warm_times.values()), 3)
    if failed:
        out["failed"] = failed
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
