"""Batch job: run registered queries over one input folder and write each result.

    zip -r staylens.zip staylens
    spark-submit --py-files staylens.zip staylens/plans/run.py \
        --input /data/tpch --output /data/out \
        [--queries price_by_room,kpi_summary] [--partition-by room_type] [--tune]

(locally: ``python -m staylens.plans.run --input ... --output ...``)

The session comes from the platform (``getOrCreate``): its ``spark.checkpoint.dir``
receives the derived listings table, so a lost executor re-reads it instead of
re-running the joins.  Every result is written as Parquet under
``<output>/<query>/`` by the executors; nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession

from staylens.operators.filters import FilterSpec
from staylens.plans.catalog import QUERIES
from staylens.plans.context import build_context, register_context
from staylens.plans.kept import FOLDER
from staylens.session import input_bytes, remove_scratch, tune_for_input
from staylens.sources.listings import listings_from_tpch

TABLES = ("orders", "customer", "nation", "region", "lineitem")


def run(spark: SparkSession, input_dir: str, output_dir: str, queries=None,
        partition_by: tuple[str, ...] = (), tune: bool = False) -> dict[str, float]:
    if tune:
        tune_for_input(spark, input_bytes(spark, [os.path.join(input_dir, f"{t}.parquet") for t in TABLES]))
    t0 = time.perf_counter()
    ctx = build_context(spark, listings_from_tpch(spark, input_dir), FilterSpec(),
                        partition_by=partition_by)
    register_context(spark, input_dir, ctx)   # every query of the run reuses it
    times = {"build_context": round(time.perf_counter() - t0, 3)}
    for name in queries or list(QUERIES):
        t = time.perf_counter()
        QUERIES[name](spark, input_dir).write.mode("overwrite").parquet(
            os.path.join(output_dir, name))
        times[name] = round(time.perf_counter() - t, 3)
    return times


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    ap.add_argument("--input", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--queries", default="")
    ap.add_argument("--partition-by", default="")
    ap.add_argument("--tune", action="store_true", help="size shuffles from the input")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("staylens-run").getOrCreate()
    times = run(spark, a.input, a.output, [q for q in a.queries.split(",") if q] or None,
                tuple(c for c in a.partition_by.split(",") if c), a.tune)
    remove_scratch(spark, but=(FOLDER,))      # results are written; kept tables stay
    print(json.dumps(times))


if __name__ == "__main__":
    main()
