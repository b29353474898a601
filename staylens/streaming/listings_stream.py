"""Listings arriving as files: the same cleaning and enrichment, running KPIs.

The dashboard's "real-time" view re-evaluates summaries when inputs change.
Here new listing files dropped into a folder are picked up by a file-source
stream; cleaning and enrichment are stateless column expressions, so the batch
operators apply unchanged.  Price quintile edges come from a batch baseline and
are passed in as constants (:class:`PriceBounds`), so the stream needs no global
state for them.  Running KPIs per room type are a streaming aggregation whose
state is one row per room type; distinct hosts use ``approx_count_distinct``
(exact distinct counts are not supported on streams).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators.features import PriceBounds, clean_listings, enrich
from staylens.session import scratch_path
from staylens.sources.listings import LISTINGS_SCHEMA, TEXT_SCHEMA, conform


def enriched_stream(spark: SparkSession, source_dir: str, bounds: PriceBounds,
                    fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    if fmt == "csv":   # listing dumps: text columns, prices like "$1,234.00"
        reader = (spark.readStream.schema(TEXT_SCHEMA).format("csv").option("header", True)
                  .option("multiLine", True).option("escape", '"'))
    else:
        reader = spark.readStream.schema(LISTINGS_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(source_dir)
    return enrich(clean_listings(conform(raw) if fmt == "csv" else raw), bounds)


def kpi_stream(stream: DataFrame, key: str = "room_type") -> DataFrame:
    return (stream.groupBy(key).agg(
        F.count(F.lit(1)).alias("listings"), F.avg("price").alias("avg_price"),
        F.avg("occupancy_rate").alias("avg_occupancy"),
        F.approx_count_distinct("host_id").alias("approx_hosts")))


def run_to_memory(agg: DataFrame, name: str, checkpoint: str | None = None):
    """Run a streaming aggregation to a memory table until the input is drained
    (tests, notebooks).  The checkpoint lives under the shared checkpoint dir."""
    spark = agg.sparkSession
    q = (agg.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", checkpoint or scratch_path(spark, f"stream-{name}"))
         .start())
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def write_kpis(agg: DataFrame, path: str, checkpoint: str | None = None,
               trigger_seconds: int | None = None):
    """Keep a Parquet snapshot of a streaming aggregation at ``path``.

    Each micro-batch of the complete-mode result (one row per key) replaces the
    snapshot; the checkpoint under the shared folder lets a restarted query resume
    where it stopped.  Returns the running query.
    """
    spark = agg.sparkSession

    def snapshot(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    w = (agg.writeStream.outputMode("complete").foreachBatch(snapshot)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-kpis")))
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
