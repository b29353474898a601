"""Joining per-key aggregates back to rows when some keys are hot.

``rows JOIN groupBy(key).agg(...)`` shuffles every row to the task owning its
key; a key holding a third of all rows would make one task read a third of the
table.  :func:`attach_key_count` keeps that bounded, by one plan for all sizes:

1. counts per key come from a ``groupBy`` with map-side partial aggregation (a
   hot key costs one row per map task, not a shuffle of its rows);
2. a key is hot if it has more than one in ``SHARES`` of all rows, so there are
   fewer than ``SHARES`` hot keys: a proven bound on the table that is broadcast;
3. rows of hot keys get a salt ``pmod(xxhash64(salt_col), buckets)`` - a
   deterministic value, so a retried task after executor loss computes the same
   salt - and the hot keys' count rows are replicated once per bucket; the
   join on ``(key, salt)`` then gives every task at most about one in ``SHARES`` of the
   rows for a key.  Other keys keep salt 0 and need no replication.

Nothing is collected or kept: the counts are part of the plan, and Spark reuses
their exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 1000


def attach_key_count(df: DataFrame, key: str, name: str, salt_col: str, *,
                     shares: int = SHARES) -> DataFrame:
    """``df`` with a column ``name`` = number of rows sharing its ``key``; rows with a
    null key go."""
    counts = (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.count(F.lit(1)).alias(name)))
    total = counts.agg(F.sum(name).alias("_total"))
    hot = (counts.crossJoin(F.broadcast(total))   # one row
           .where(F.col(name) * F.lit(shares) > F.col("_total"))
           .select(key, F.ceil(F.col(name) * F.lit(shares) / F.col("_total")).cast("int")
                   .alias("_buckets")))
    buckets = F.coalesce(F.col("_buckets"), F.lit(1))
    salted_rows = (df.join(F.broadcast(hot), key, "left")
                   .withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_col)), buckets).cast("int"))
                   .drop("_buckets"))
    salted_counts = (counts.join(F.broadcast(hot), key, "left")
                     .withColumn("_salt", F.explode(F.sequence(F.lit(0), buckets - 1)))
                     .select(key, "_salt", name))
    return salted_rows.join(salted_counts, [key, "_salt"]).drop("_salt")
