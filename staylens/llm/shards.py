"""Sharding by weighted rendezvous hashing (DataFrame functions only).

Each (key, shard) pair has a pseudo-random u in (0, 1); a record goes to the shard
with the largest ``weight / -ln(u)``.  The choice depends on the key and the shards
alone, so adding a shard moves only the records that the new shard wins, in
proportion to its weight (the law ``key``).

A record's slot within its shard is gapless: records are dealt into small buckets of
their shard by a hash, numbered there, and shifted by the counts of the buckets
before, so no task holds a whole shard.

Defined cases: a null text has no bytes; a null key is one key like any other; equal
keys meet in one shard and have different slots; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import whole_text

N_SHARDS = 24


def _score(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard-{shard}")), 12)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard's number; of equal scores, the lowest number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("n"))
              for i, w in enumerate(weights)]
    return -(scores[0] if len(scores) == 1 else F.greatest(*scores))["n"]


def stable_key(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def gapless_slots(rows: DataFrame, shard: str, spread: Sequence[str], buckets: int) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... within each shard."""
    bucket = "__bucket"
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    at = [shard, bucket]
    counts = dealt.groupBy(*at).agg(F.count("*").alias("__n"))
    ahead = (Window.partitionBy(shard).orderBy(bucket)
             .rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*at, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy(*at).orderBy(*spread)) - 1
    return (dealt.withColumn("__nth", nth).join(starts, at)
            .withColumn("slot", (F.col("__start") + F.col("__nth")).cast("long"))
            .drop(bucket, "__nth", "__start"))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * N_SHARDS,
                    added_weight: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard
    (the shard after one more of ``added_weight`` is added)."""
    n = len(weights)
    key = stable_key()
    spark = docs.sparkSession
    body = whole_text().cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key, weights).cast("int").alias("shard"),
        rendezvous(key, (*weights, added_weight)).cast("int").alias("grown_shard"))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return gapless_slots(rows, "shard", ("doc_id", "text_crc32", "size"), buckets).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
