"""Connected components of a link table by alternating stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import store


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a leaf (u, of one edge) to a centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")) \
        .unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("leaf"),
                                  F.lit(1).alias("centre")))
    return (ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
            .filter(F.col("leaf") + F.col("centre") > 1).isEmpty())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (``large``) or smaller neighbours to the smallest one.

    The smallest neighbour is an aggregate and comes back by a join, so no node's
    neighbours are gathered in one place.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"),
                                                         F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, class) of the nodes of ``links`` (u, v); a class is named by its smallest
    node.  Links of a node with itself or with a null end are ignored; repeated links count
    once; no links give no rows."""
    edges = store(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .filter(F.col("u") != F.col("v")).distinct(), "links")
    while not _are_stars(edges):
        edges = store(_star(_star(edges, True), False), "links")
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(centres)
