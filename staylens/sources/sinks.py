"""Exports of the filtered table: distributed writes, one file set per task.

The dashboard builds CSV, a two-sheet workbook and JSON text in memory; at scale
each becomes a directory written by the executors.  The workbook is re-aimed as
two sibling datasets, ``listings/`` and ``summary/`` (no xlsx codec).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """All rows and columns, header row, no index."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON Lines, one record per row, null fields kept; dates as ISO text."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def export_bundle(df: DataFrame, summary: DataFrame, path: str, mode: str = "overwrite") -> dict:
    """The two-sheet export as two datasets under ``path``."""
    listings = os.path.join(path, "listings")
    summ = os.path.join(path, "summary")
    export_csv(df, listings, mode)
    # the summary has five rows: a single output file keeps it one "sheet"
    summary.coalesce(1).write.mode(mode).option("header", True).csv(summ)
    return {"listings": listings, "summary": summ}


def export_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                   partition_by: list[str] | None = None) -> str:
    """The preferred store for the enriched table (columnar, pushdown, pruning)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
