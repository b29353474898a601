"""Exact dedup by heavy-hitter split (DataFrame functions only).

A text's digest is its SHA-256.  A Misra-Gries summary (``freqItems``, an aggregate
of 1 / ``support`` counters) names every digest that may hold more than ``support``
of the rows; an exact count verifies these, so at most 1 / ``support`` winners exist
and their broadcast is bounded.  Rows of a winner are decided where they are read.
The remaining digests go through an ordinary shuffle, pre-aggregated per
(digest, id), in which no group holds more than ``support`` of the rows.

Defined cases: a null text counts as empty; of equal texts the row with the largest
id stays, a null id being smaller than any other; of rows equal in id and text one
stays; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import store, whole_text, without_marked

SUPPORT = 0.001


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row, stored, so that texts are read and hashed once."""
    return store(docs.select(F.col(id_col).alias("doc_id"),
                             F.sha2(whole_text(text_col).cast("binary"), 256).alias("digest")),
                 "digests")


def winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests holding more than ``support`` of the rows, with their exact counts.

    (digest, keep_id, group_size); at most 1 / ``support`` rows.
    """
    total = rows.count()
    candidates = (rows.stat.freqItems(["digest"], support)
                  .select(F.explode("digest_freqItems").alias("digest")).distinct())
    return store(rows.join(F.broadcast(candidates), "digest")
                 .groupBy("digest")
                 .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                 .filter(F.col("group_size") > F.lit(support * total)), "winners")


def mark_copies(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """For each row of :func:`digests`: doc_id, digest, keep_id, group_size, kept; ``hot``
    are their :func:`winners`."""
    marked = rows.join(F.broadcast(hot), "digest", "left")
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    is_hot = F.col("group_size").isNotNull()
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    removed = marked.filter(is_hot & ~stays).select(*columns, F.lit(False).alias("kept"))
    held = (marked.filter(is_hot & stays)
            .groupBy(*columns).agg(F.count("*").alias("copies")))
    cold = (marked.filter(~is_hot).groupBy("digest", "doc_id")
            .agg(F.count("*").alias("copies")))
    groups = cold.groupBy("digest").agg(F.max("doc_id").alias("keep_id"),
                                        F.sum("copies").alias("group_size"))
    rest = cold.join(groups, "digest").unionByName(held)
    nth = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")
    rest = (rest.select(*columns, nth)
            .select(*columns, (stays & (F.col("nth") == 1)).alias("kept")))
    return removed.unionByName(rest)


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs)
    return mark_copies(rows, winners(rows, support)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with all their columns.

    A winner's copies are dropped where they are read; of the others, the (digest,
    doc_id) pairs that go are taken out by one join (:func:`without_marked`).
    """
    rows = digests(docs)
    hot = winners(rows, support)
    fates = (mark_copies(rows, hot).groupBy("digest", "doc_id")
             .agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
             .filter(~F.col("kept") | (F.col("copies") > 1)))
    digest, hot_id = "__digest", "__hot_id"
    named = docs.withColumn(digest, F.sha2(whole_text().cast("binary"), 256))
    known = hot.select(F.col("digest").alias(digest), F.struct("keep_id").alias(hot_id))
    named = (named.join(F.broadcast(known), digest, "left")
             .filter(F.col(hot_id).isNull() | F.col(hot_id)["keep_id"].eqNullSafe(F.col("doc_id")))
             .drop(hot_id))
    return without_marked(named, digest, fates).select(*docs.columns)


ORACLE = """
SELECT doc_id,
       MAX(doc_id) OVER (PARTITION BY t) AS keep_id,
       COUNT(*) OVER (PARTITION BY t) AS group_size,
       ROW_NUMBER() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents)
"""
