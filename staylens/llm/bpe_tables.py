"""BPE encoding through a table of distinct words, decoding through a table of pieces.

Texts are cut into the tokenizer's words in Spark tasks and kept as dictionary-coded
blocks (:mod:`staylens.llm.blocks`).  Each distinct word is encoded once, in the
bucket that its hash names, and its ids go back to every block that asked for it,
where they replace the word's codes by position.  Decoding joins each id with its
piece; the pieces are one row per id of the vocabulary, a bound known beforehand, so
that join is map-side by broadcast.  Bytes that are no valid UTF-8 become U+FFFD.

Defined cases: a null text counts as empty and has no ids; repeated rows stay
repeated; an empty table gives no rows; an id outside the vocabulary decodes to
nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import blocks as bl
from staylens.llm.bpe import word_bpe
from staylens.llm.common import map_arrow, rows_of, slices, whole_text

_ANSWER = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("answer", pa.binary())])
_ANSWER_DDL = "block long, at binary, answer binary"


def _pack_ids(ids: list[tuple[int, ...]]) -> bytes:
    sizes = bl.pack_ints(np.array([len(i) for i in ids]))
    flat = bl.pack_ints(np.array([x for i in ids for x in i]))
    return len(sizes).to_bytes(4, "little") + sizes + flat


def _unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    return bl.unpack_ints(data[4:4 + n]), bl.unpack_ints(data[4 + n:])


def word_ids(asked: DataFrame, tokenizer: str) -> DataFrame:
    """Answers to the blocks' requests: the ids of each word, encoded once per bucket."""

    def encode(table: pa.Table) -> pa.Table:
        bpe = word_bpe(tokenizer)
        known: dict[bytes, tuple[int, ...]] = {}
        out = []
        for block, at, packed in rows_of([table], "block", "at", "ask"):
            words = bl.unpack_words(packed)
            for w in words:
                if w not in known:
                    known[w] = bpe.word(w.decode())
            out.append((block, at, _pack_ids([known[w] for w in words])))
        return pa.Table.from_batches(slices(out, _ANSWER, size=1 << 30, weight=1 << 40), _ANSWER)

    return bl.answer(asked, encode, _ANSWER_DDL)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of every document."""

    def splitter():
        return word_bpe(tokenizer).split

    texts = docs.select("doc_id", whole_text().alias("text"))
    blocks = bl.word_blocks(texts, splitter, "bpe-blocks")
    buckets = bl.n_buckets(blocks)
    answers = word_ids(bl.ask_words(blocks, buckets), tokenizer)
    gathered = answers.groupBy("block").agg(
        F.collect_list(F.struct("at", "answer")).alias("answers"))
    full = blocks.select("block", "doc_ids", "lens", "codes", "n_words").join(
        gathered, "block", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, lens, packed, n_words, got in rows_of(
                batches, "doc_ids", "lens", "codes", "n_words", "answers"):
            sizes = np.zeros(n_words, dtype=np.int64)
            starts = np.zeros(n_words, dtype=np.int64)
            parts, used = [np.zeros(0, np.int64)], 0
            for a in got or []:
                at = bl.unpack_rising(a["at"])
                n, flat = _unpack_ids(a["answer"])
                sizes[at] = n
                starts[at] = used + np.cumsum(n) - n
                parts.append(flat)
                used += len(flat)
            table = np.concatenate(parts).astype(np.int32)
            codes = bl.unpack_ints(packed)
            ends = np.cumsum(lens)
            for i in range(0, len(doc_ids), 500):
                j = min(i + 500, len(doc_ids))
                first = int(ends[i - 1]) if i else 0
                here = codes[first:int(ends[j - 1])]
                n = sizes[here]
                stop = np.cumsum(n)
                flat = table[np.repeat(starts[here] - (stop - n), n) + np.arange(n.sum())]
                bounds = np.concatenate([[0], stop])[
                    np.concatenate([[0], ends[i:j] - first]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[i:j], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                              pa.array(flat, pa.int32()))], schema=schema)

    return map_arrow(full.select("doc_ids", "lens", "codes", "n_words", "answers"), assemble,
                     "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``text``, each id replaced by its piece."""
    pieces = encoded.sparkSession.sparkContext.broadcast(word_bpe(tokenizer).pieces())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())),
                        ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value
        yield from slices(((doc_id, ids, _text(ids, table))
                           for doc_id, ids in rows_of(batches, "doc_id", "ids")), schema, 500)

    return map_arrow(encoded.select("doc_id", "ids"), decode,
                     "doc_id long, ids array<int>, text string")


def _text(ids: list[int], pieces: list[bytes]) -> str:
    return b"".join([pieces[i] if 0 <= i < len(pieces) else b"" for i in ids]) \
        .decode("utf-8", "replace")


def round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
                        *[("ids", pa.list_(pa.int32()))] * with_ids])
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" \
        + ", ids array<int>" * with_ids

    texts = docs.sparkSession.sparkContext.broadcast(word_bpe(tokenizer).pieces())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = texts.value
        numerals = [str(i) for i in range(len(pieces))]

        def rows():
            for doc_id, ids in rows_of(batches, "doc_id", "ids"):
                yield (doc_id, len(ids),
                       hashlib.sha256(",".join([numerals[i] for i in ids]).encode()).hexdigest(),
                       hashlib.sha256(_text(ids, pieces).encode()).hexdigest(), *[ids] * with_ids)

        yield from slices(rows(), schema)

    return map_arrow(encode(docs, tokenizer), digest, ddl)
