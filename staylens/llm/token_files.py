"""Token-id files with Elias-Fano document boundaries.

Documents are dealt by ranges of their id, each range sorted and encoded in one
task, which writes segments: one row of a Parquet file each, holding the
concatenated ids of whole documents (2 bytes an id where the vocabulary allows, else
4), the documents' ids, and the Elias-Fano code of the boundaries.  The code keeps
the low bits of each boundary packed and the high bits in a unary bit vector, with
the position of every 256th set bit as a select structure, so a boundary is found
without a table of 64-bit offsets.  Spark's writer commits whole tasks, so a lost
executor leaves no half-written segment, and the files lie wherever Spark can write.

A segment states the ids before it in its range; the ranges' totals (one row per
range, a bound known beforehand) give the global start.

Defined cases: a null text is empty and has only the end id; null ids sort first;
rows of equal id lie in the order of their text's hash; an empty table gives no
segments and no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.llm.bpe import word_bpe
from staylens.llm.common import map_arrow, rows_of, slices, whole_text

SEGMENT_IDS = 1 << 19
SAMPLE = 256

_SEGMENT = pa.schema([
    ("part", pa.int32()), ("seg", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
    ("width", pa.int32()), ("n_null", pa.int32()), ("first_id", pa.int64()),
    *((f"{c}_{f.name}", f.type) for c in ("bound", "doc") for f in (
        pa.field("n", pa.int32()), pa.field("low_bits", pa.int32()), pa.field("low", pa.binary()),
        pa.field("high", pa.binary()), pa.field("samples", pa.binary()))),
    ("ids", pa.binary())])
_SEGMENT_DDL = ("part int, seg int, before long, n_ids long, width int, n_null int, "
                "first_id long, "
                + "".join(f"{c}_n int, {c}_low_bits int, {c}_low binary, {c}_high binary, "
                          f"{c}_samples binary, " for c in ("bound", "doc")) + "ids binary")
_BOUNDS = ("bound_n", "bound_low_bits", "bound_low", "bound_high", "bound_samples")
_DOC_IDS = ("n_null", "first_id", "doc_n", "doc_low_bits", "doc_low", "doc_high", "doc_samples")
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                   ("ids_crc32", pa.int64())])
_DOCS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about
    2 + log2(max / n) bits each, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n and top >= n else 0
        rest = values & np.uint64((1 << low_bits) - 1)
        bits = (rest[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        vector[ones] = 1
        high = np.packbits(vector, bitorder="little").tobytes()
        return cls(n, low_bits, low, high, ones[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> tuple:
        return self.n, self.low_bits, self.low, self.high, self.samples

    def select(self, i: int) -> int:
        """The ``i``-th value: from the nearest sample, bytes are skipped by popcount."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        value = self.high[byte] >> (at % 8) << (at % 8)
        while (count := value.bit_count()) <= left:
            left -= count
            byte += 1
            value = self.high[byte]
        for _ in range(left):
            value &= value - 1
        one = byte * 8 + (value & -value).bit_length() - 1
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8:(first + self.low_bits + 7) // 8], "little")
        low = (window >> (first % 8)) & ((1 << self.low_bits) - 1)
        return ((one - i) << self.low_bits) | low

    def values(self) -> np.ndarray:
        """All values at once."""
        vector = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        high = (np.flatnonzero(vector)[:self.n] - np.arange(self.n)).astype(np.int64)
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little",
                             count=self.n * self.low_bits)
        weights = np.int64(1) << np.arange(self.low_bits)
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ weights
        return (high << self.low_bits) | low


def _id_code(doc_ids: list) -> tuple:
    """Number of null ids (they come first), the first id, and the code of the rest."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    code = EliasFano.encode(np.array([d - first for d in known], dtype=np.uint64))
    return (len(doc_ids) - len(known), first), code


def _ids_of(n_null: int, first: int, *code) -> list:
    """The documents' ids of a segment."""
    ids = EliasFano(*code).values() + np.int64(first)
    return [None] * n_null + ids.tolist()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                      segment_ids: int = SEGMENT_IDS) -> str:
    """Encode every text and write the segments below ``path``."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select("doc_id", whole_text().alias("text"))
               .repartitionByRange(n, "doc_id")
               .sortWithinPartitions("doc_id", F.xxhash64("text")))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        width = 2 if bpe.size <= 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        part = TaskContext.get().partitionId()
        seg, before, held, size = 0, 0, [], 0

        def close():
            bounds = np.zeros(len(held) + 1, dtype=np.int64)
            np.cumsum([len(ids) // width for _, ids in held], out=bounds[1:])
            head, doc_code = _id_code([d for d, _ in held])
            return (part, seg, before, size, width, *head, *EliasFano.encode(bounds).parts(),
                    *doc_code.parts(), b"".join(ids for _, ids in held))

        def rows():
            nonlocal seg, before, held, size
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                ids = bpe.packed(text, width) + end
                held.append((doc_id, ids))
                size += len(ids) // width
                if size >= segment_ids:
                    yield close()
                    seg, before, held, size = seg + 1, before + size, [], 0
            if held:
                yield close()

        yield from slices(rows(), _SEGMENT, size=8)

    map_arrow(ordered, segments, _SEGMENT_DDL).write.parquet(path)
    return path


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each range: (part, base), one row per range."""
    totals = (spark.read.schema(_SEGMENT_DDL).parquet(path)
              .groupBy("part").agg(F.sum("n_ids").alias("n")))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids before them in the whole corpus."""
    rows = spark.read.schema(_SEGMENT_DDL).parquet(path)
    # one row per range: bounded by the number of shuffle partitions used for writing
    return (rows.join(F.broadcast(segment_starts(spark, path)), "part")
            .withColumn("start", F.col("base") + F.col("before")))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers)."""
    fields = ("start", "width", "ids", *_BOUNDS, *_DOC_IDS)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for start, width, ids, *codes in rows_of(batches, *fields):
                bounds = EliasFano(*codes[:len(_BOUNDS)]).values().tolist()
                words = np.frombuffer(ids, f"<u{width}").astype("<u4")
                for doc_id, a, b in zip(_ids_of(*codes[len(_BOUNDS):]), bounds, bounds[1:]):
                    yield doc_id, start + a, b - a, zlib.crc32(words[a:b].tobytes())

        yield from slices(rows(), _DOCS, size=20_000)

    return map_arrow(read_segments(spark, path).select(*fields), documents, _DOCS_DDL)


def document_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Random access: (doc_id, ids) of the documents named in ``wanted.doc_id``, each cut
    out of its segment by two selects.  The ids' codes are read first; only segments
    that hold a wanted document have their token ids read.  A null id names nothing."""
    files = spark.read.schema(_SEGMENT_DDL).parquet(path)
    places = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("nth", pa.int32()),
                        ("doc_id", pa.int64())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part, seg, *code in rows_of(batches, "part", "seg", *_DOC_IDS):
                for nth, doc_id in enumerate(_ids_of(*code)):
                    if doc_id is not None:
                        yield part, seg, nth, doc_id

        yield from slices(rows(), places, size=20_000)

    asked = (map_arrow(files.select("part", "seg", *_DOC_IDS), listed,
                       "part int, seg int, nth int, doc_id long")
             .join(wanted.select("doc_id").distinct(), "doc_id")
             .groupBy("part", "seg").agg(F.collect_list(F.struct("nth", "doc_id")).alias("ask")))
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    fields = ("ask", "width", "ids", *_BOUNDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for ask, width, ids, *code in rows_of(batches, *fields):
                bounds, words = EliasFano(*code), np.frombuffer(ids, f"<u{width}")
                for one in ask:
                    a, b = bounds.select(one["nth"]), bounds.select(one["nth"] + 1)
                    yield one["doc_id"], words[a:b].tolist()

        yield from slices(rows(), out)

    return map_arrow(files.join(asked, ["part", "seg"]).select(*fields), cut,
                     "doc_id long, ids array<long>")
