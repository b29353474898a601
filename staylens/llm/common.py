"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.session import scratch_path


_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per context (as ``--py-files`` would);
    the archive is made on the driver and Spark distributes it."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="staylens-code-"), name)
    sc.addPyFile(shutil.make_archive(archive, "zip", root, name))
    _SHIPPED.add(sc)


def map_arrow(df: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    """``df.mapInArrow`` for functions of this package."""
    ship_code(df.sparkSession)
    return df.mapInArrow(_returning_memory(fn), ddl)


def _returning_memory(fn: Callable) -> Callable:
    """``fn``, after which the worker gives unused memory back: workers serve one stage
    after the other, and each would keep the most that any of them needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # freed blocks of the system's allocator go back at once, Arrow's own would stay
        pa.set_memory_pool(pa.system_memory_pool())
        yield from fn(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs a re-read, and results that depend on
    how rows were dealt to tasks are fixed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def store_bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like :func:`store`, bucketed by ``column``: joins on it shuffle only the other
    side.  The files lie below the shared checkpoint folder; the table's name, which only
    Spark's writer needs, is dropped from the catalogue (files of an external table stay)."""
    spark = df.sparkSession
    key = uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    title = f"llm_{name.replace('-', '_')}_{key}"
    (df.write.bucketBy(n, column).sortBy(column).format("parquet")
     .option("path", scratch_path(spark, f"llm-{name}-{key}")).saveAsTable(title))
    table_ = spark.table(title)
    spark.sql(f"DROP TABLE {title}")
    return table_


def without_marked(named: DataFrame, digest: str, fates: DataFrame) -> DataFrame:
    """The rows of ``named`` without those whose ``digest`` and doc_id ``fates`` (digest,
    doc_id, kept, copies) names; of rows repeated in both that it names as kept, one stays.

    Texts are dealt out once, in the anti join.  The repeated rows, few or none, are listed
    first and fetched by a join with their own short list."""
    own = fates.select(F.col(fates.columns[0]).alias("__d"), F.col("doc_id").alias("__i"),
                       "kept", "copies")
    same = [F.col(digest) == F.col("__d"), F.col("doc_id").eqNullSafe(F.col("__i"))]
    single = named.join(own, same, "left_anti")
    repeated = store(own.filter(F.col("kept") & (F.col("copies") > 1)).select("__d", "__i"),
                     "repeated-rows")
    if repeated.isEmpty():
        return single
    return single.unionByName(named.join(repeated, same, "left_semi")
                              .dropDuplicates([digest, "doc_id"]))


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def whole_text(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches (or tables), row by row; few rows at a time
    become Python values."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names))


def slices(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000,
           weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of at most ``size`` rows and about
    ``weight`` bytes of text or binary values."""
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(v) for v in row if isinstance(v, (bytes, str, list)))
        if len(held) >= size or held_bytes >= weight:
            yield _batch(held, schema)
            held, held_bytes = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)
