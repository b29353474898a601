"""Dictionary-coded blocks of documents, and an exchange of words between them.

A block holds the documents that one task has read in a row, as codes into the list
of the block's own distinct words, so a word's occurrences are stored as small
numbers and the word itself once.  Whatever depends on a word (its token ids, its
count in the corpus) is found once per distinct word: each block asks for its words
by bucket of their hash, a grouped task per bucket answers all blocks, and the
answers come back to the block by a join on its number and are placed by code.

Blocks are written to the shared folder before use: their numbers and codes depend on
how rows were dealt to tasks.  They are bucketed by number, so joins with answers
shuffle the answers only.  A block ends at ``MAX_TOKENS`` tokens or ``MAX_WORDS``
distinct words (a longer document has a block of its own), which bounds memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, rows_of, ship_code, slices, store_bucketed

MAX_TOKENS = 1_200_000
MAX_WORDS = 200_000
BUCKET_WORDS = 150_000

_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("flags", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32())),
                    ("codes", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64()),
                    ("n_tokens", pa.int64())])
_BLOCK_DDL = ("block long, doc_ids array<long>, flags array<boolean>, lens array<int>, "
              "codes binary, words binary, n_words long, n_tokens long")
_ASK = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("at", pa.binary()),
                  ("ask", pa.binary())])
_ASK_DDL = "bucket long, block long, at binary, ask binary"


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest whole bytes, byte by byte, compressed."""
    values = np.ascontiguousarray(values, dtype="<u8")
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack_ints(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(w) for w in words], dtype="<u4")
    head = np.array([len(words)], dtype="<u4").tobytes()
    return zstandard.compress(head + sizes.tobytes() + b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    ends = np.cumsum(np.frombuffer(raw[4:4 + 4 * n], "<u4")).tolist()
    body = raw[4 + 4 * n:]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def buckets_of(words: list[bytes], n_buckets: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
    return (hashes % np.uint64(n_buckets)).astype(np.int64)


def pack_rising(values: np.ndarray) -> bytes:
    """Non-decreasing integers, as differences."""
    return pack_ints(np.diff(values, prepend=0))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data))


def by_bucket(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in rising order) of each bucket in ``at``."""
    order = np.argsort(at, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        if len(part):
            yield int(at[part[0]]), part


def word_blocks(docs: DataFrame, splitter: Callable[[], Callable[[str], list]],
                name: str) -> DataFrame:
    """Stored blocks of ``docs`` (doc_id, text, and flag where there is one);
    ``splitter`` is called on the worker and returns the function that cuts a text
    into words (str or bytes)."""
    flagged = "flag" in docs.columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        part, seq = TaskContext.get().partitionId(), 0

        def rows():
            nonlocal seq
            place: dict = {}
            doc_ids, flags, lens, codes = [], [], [], []
            total = 0

            def close():
                flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
                # codes by falling frequency: small numbers compress well
                order = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
                rank = np.empty(len(place), dtype=np.int64)
                rank[order] = np.arange(len(place))
                held = list(place)
                words = [w if isinstance(w, bytes) else w.encode() for w in
                         (held[i] for i in order.tolist())]
                return ((part << 24) + seq, doc_ids, flags, lens, pack_ints(rank[flat]),
                        pack_words(words), len(words), total)

            for doc_id, text, *flag in rows_of(batches, "doc_id", "text",
                                               *["flag"] * flagged):
                words = split(text)
                put = place.setdefault
                codes.append(np.fromiter((put(w, len(place)) for w in words),
                                         dtype=np.uint32, count=len(words)))
                doc_ids.append(doc_id)
                flags.append(flag[0] if flagged else None)
                lens.append(len(words))
                total += len(words)
                if total >= MAX_TOKENS or len(place) >= MAX_WORDS:
                    yield close()
                    place, doc_ids, flags, lens, codes, total = {}, [], [], [], [], 0
                    seq += 1
            if doc_ids:
                yield close()

        yield from slices(rows(), _BLOCK, size=1)

    columns = ["doc_id", "text", *["flag"] * flagged]
    return store_bucketed(map_arrow(docs.select(*columns), build, _BLOCK_DDL), name, "block")


def n_buckets(blocks: DataFrame, per_bucket: int = BUCKET_WORDS) -> int:
    """Buckets for all (block, word) pairs, about ``per_bucket`` of them each."""
    pairs = blocks.agg(F.sum("n_words")).first()[0] or 0
    return max(1, math.ceil(pairs / per_bucket))


def ask_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, at, ask): codes and words of the block's words of the bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for block, packed in rows_of(batches, "block", "words"):
                words = unpack_words(packed)
                for bucket, part in by_bucket(buckets_of(words, buckets)):
                    yield (bucket, block, pack_rising(part),
                           pack_words([words[i] for i in part.tolist()]))

        yield from slices(rows(), _ASK, size=64)

    return map_arrow(blocks.select("block", "words"), ask, _ASK_DDL)


def answer(asked: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    """One grouped task per bucket: ``fn`` takes the bucket's requests as an Arrow table."""
    ship_code(asked.sparkSession)
    return asked.groupBy("bucket").applyInArrow(fn, ddl)
