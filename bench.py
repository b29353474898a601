"""Benchmark: every registered query over the listing star view of one scale.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default all).  Prints one JSON line.

Each query is executed with the ``noop`` sink (all rows produced, none collected)
after the shared context (star view -> clean -> bounds -> cached baseline) has
been built once; that build is reported as ``build_context``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from staylens.plans.catalog import QUERIES
    from staylens.plans.context import tpch_context
    from staylens.session import checkpoint_dir, input_bytes, local_session, tune_for_input

    spark = local_session(cores=cpus, shuffle_partitions=max(8, cpus * 2), app="staylens-bench")
    checkpoint_dir(spark)
    tables = ("orders", "customer", "nation", "region", "lineitem")
    partitions = tune_for_input(spark, input_bytes(
        spark, [os.path.join(sf_dir, f"{t}.parquet") for t in tables]))

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    ctx = tpch_context(spark, sf_dir)
    ctx.baseline.write.format("noop").mode("overwrite").save()
    times["build_context"] = round(time.perf_counter() - t0, 3)

    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t = time.perf_counter()
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "shuffle_partitions": partitions,
                      "n_queries": len(times) - 1}))
    spark.stop()


if __name__ == "__main__":
    main()
