"""Kept tables: written once per input and found again by later sessions.

A table's name is a fingerprint of the files that it was made of (path, length and time
of change, read by Spark's file listing), of its schema and of the code that makes it.  A
complete table (Spark's ``_SUCCESS`` mark) of the same fingerprint is read instead of made
again; one that a lost job left incomplete is overwritten.  :func:`remove_kept` removes the
others, so that changed inputs leave nothing behind.

All access is through Spark and its file systems, never by local paths.  A table that is
not made of files has no fingerprint.
"""

from __future__ import annotations

import hashlib
import inspect
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.session import file_system, scratch_path

FOLDER = "listings-kept"


def fingerprint(df: DataFrame, code: tuple[ModuleType, ...]) -> str | None:
    """A name for what ``df`` is made of; the files' rows are added up on the executors."""
    files = df.inputFiles()
    if not files:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(files).select(
        "path", "length", "modificationTime")
    mark = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "length", "modificationTime"), 256),
                              1, 15), 16, 10).cast("decimal(20,0)")
    total = listed.agg(F.count("*").alias("n"), F.sum(mark).alias("mark"),
                       F.sum("length").alias("length")).first()
    text = "\n".join([str(tuple(total)), df.schema.simpleString(), *map(inspect.getsource, code)])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def is_complete(spark: SparkSession, path: str) -> bool:
    fs, place = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(place)


def keep(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as the kept table ``name``: read if it is there, else written and read."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{FOLDER}/{name}")
    if not is_complete(spark, path):
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    # partition columns come back last: keep the schema's order
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def kept_names(spark: SparkSession) -> list[str]:
    fs, place = file_system(spark, scratch_path(spark, FOLDER))
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove_kept(spark: SparkSession, but: tuple[str, ...] = ()) -> list[str]:
    """Remove the kept tables, but for those named; returns the names of the removed ones."""
    gone = [n for n in kept_names(spark) if n not in but]
    for name in gone:
        fs, place = file_system(spark, scratch_path(spark, f"{FOLDER}/{name}"))
        fs.delete(place, True)
    return gone
