"""Term counts over UTF-8 buffers by length-bucketed packing.

Terms are found in the bytes of whole Arrow batches at once, never as Python strings.  A
term of up to 8 bytes is one big-endian 64-bit word, one of up to 16 bytes two: they sort
like their bytes.  Occurrences are put in order by a radix sort over 16-bit digits, group
first and then the words, and runs are counted; the sort is stable, so the documents of a run
stay in order and distinct ones are counted too.  Longer terms have a bucket of their
own, sorted as bytes.

A term is a longest run of ASCII letters and bytes from 0x80, upper-case letters
lowered; in valid UTF-8 that is a run of ASCII letters and characters beyond ASCII.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from staylens.llm.blocks import (pack_ints, pack_rising, pack_words, unpack_ints, unpack_rising,
                                 unpack_words)

WORD = 8                # bytes of a packed word
SHORT, MIDDLE, LONG = 0, 1, 2

_BYTES = np.arange(256, dtype=np.uint8)
_IN_TERM = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) \
    | (_BYTES >= 0x80)
_LOWERED = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order that sorts by the keys, the first being the most significant; equal rows
    keep their order.  Unsigned 64-bit keys, 16 bits a pass; a digit that all rows share
    costs no pass."""
    order = np.arange(len(keys[0]), dtype=np.int64)
    for key in reversed(keys):
        spread = np.bitwise_or.reduce(key ^ key[0]) if len(key) else np.uint64(0)
        for shift in range(0, 64, 16):
            if int(spread) >> shift & 0xFFFF:
                digit = (key[order] >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit, kind="stable")]    # radix for 16-bit integers
    return order


def run_starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows start, rows being in order."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    fresh = np.ones(len(keys[0]), dtype=bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(fresh)


@dataclass
class TermCounts:
    """Counts of terms of one length class: ``group`` numbers, the terms' words (1, 2, or for
    long terms the numbers of ``texts``, which are sorted), occurrences, documents."""

    group: np.ndarray
    words: list[np.ndarray]
    count: np.ndarray
    docs: np.ndarray
    texts: list[bytes] | None = None

    @classmethod
    def runs(cls, group, words, doc, texts=None) -> "TermCounts":
        """From occurrences, documents in rising order."""
        order = radix_order([*words, group])
        group, words, doc = group[order], [w[order] for w in words], doc[order]
        start = run_starts([*words, group])
        fresh = np.zeros(len(doc), dtype=np.int64)
        fresh[1:] = doc[1:] != doc[:-1]
        fresh[start] = 1
        docs = np.add.reduceat(fresh, start) if len(start) else fresh
        return cls(group[start], [w[start] for w in words],
                   np.diff(start, append=len(group)), docs, texts)

    def packed(self) -> bytes:
        """Rows as packed arrays (terms in order: as differences), long terms behind them."""
        arrays = [pack_rising(self.words[0].view(np.int64)), *map(pack_ints, [
            *self.words[1:], self.group, self.count, self.docs])]
        if self.texts is not None:
            arrays.append(pack_words(self.texts))
        return np.array([len(arrays), *map(len, arrays)], "<u8").tobytes() + b"".join(arrays)

    @classmethod
    def unpacked(cls, data: bytes, kind: int) -> "TermCounts":
        n = int(np.frombuffer(data[:8], "<u8")[0])
        head = 8 * (n + 1)
        ends = np.cumsum([head, *np.frombuffer(data[8:head], "<u8").tolist()]).tolist()
        arrays = [data[a:b] for a, b in zip(ends, ends[1:])]
        texts = unpack_words(arrays.pop()) if kind == LONG else None
        first, *rest = (unpack_rising(arrays[0]), *map(unpack_ints, arrays[1:]))
        words = [w.astype(np.uint64) for w in (first, *rest[:-3])]
        return cls(rest[-3].astype(np.uint64), words, rest[-2], rest[-1], texts)

    @classmethod
    def merged(cls, many: list["TermCounts"]) -> "TermCounts":
        """The sums of counts whose documents are apart."""
        texts = None
        if many[0].texts is not None:
            texts = sorted(set().union(*(m.texts for m in many)))
            at = {t: i for i, t in enumerate(texts)}
            to = [np.array([at[t] for t in m.texts], dtype=np.uint64) for m in many]
            words = [np.concatenate([t[m.words[0].astype(np.int64)] for t, m in zip(to, many)])]
        else:
            words = [np.concatenate(w) for w in zip(*(m.words for m in many))]
        group = np.concatenate([m.group for m in many])
        order = radix_order([*words, group])
        group, words = group[order], [w[order] for w in words]
        start = run_starts([*words, group])
        sums = [np.add.reduceat(np.concatenate(c)[order], start) if len(start)
                else np.zeros(0, np.int64) for c in zip(*((m.count, m.docs) for m in many))]
        return cls(group[start], [w[start] for w in words], *sums, texts)

    def take(self, rows: np.ndarray) -> "TermCounts":
        texts, words = self.texts, [w[rows] for w in self.words]
        if texts is not None:
            used, number = np.unique(words[0], return_inverse=True)
            texts, words = [texts[i] for i in used.tolist()], [number.astype(np.uint64)]
        return TermCounts(self.group[rows], words, self.count[rows], self.docs[rows], texts)

    def buckets(self, n: int) -> np.ndarray:
        """A bucket below ``n`` for each row, by its term alone."""
        if self.texts is not None:
            own = np.array([zlib.crc32(t) for t in self.texts], dtype=np.uint64)
            mixed = own[self.words[0].astype(np.int64)] * _MIX
        else:
            mixed = np.zeros(len(self.group), dtype=np.uint64)
            for w in self.words:
                mixed = (mixed ^ w) * _MIX
                mixed ^= mixed >> np.uint64(29)
        return ((mixed >> np.uint64(20)) % np.uint64(n)).astype(np.int64)

    def terms(self, rows: np.ndarray) -> list[str]:
        """The terms of some rows as text."""
        if self.texts is not None:
            return [self.texts[i].decode() for i in self.words[0][rows].tolist()]
        raw = np.stack([w[rows] for w in self.words], axis=1).astype(">u8").tobytes()
        size = WORD * len(self.words)
        return [raw[i:i + size].rstrip(b"\0").decode() for i in range(0, len(raw), size)]


def occurrences(texts: pa.Array, first_doc: int, group: np.ndarray) -> Iterator[tuple]:
    """(length class, group, words or byte strings, document number) of the terms of a text
    array without nulls; ``group`` is the group number of each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _IN_TERM[raw]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    # a text's edge parts two terms that touch in the buffer
    edge = offsets[1:-1]
    edge = np.unique(edge[inside[edge] & inside[edge + 1]])
    begins[edge] = ends[edge] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    size = end - start
    doc = np.searchsorted(offsets, start, "right") - 1
    lowered = np.zeros(len(raw) + 2 * WORD, dtype=np.uint8)
    lowered[:len(raw)] = _LOWERED[raw]
    at_byte = np.lib.stride_tricks.as_strided(     # the 8 bytes from each place on
        lowered.view(), (len(raw) + WORD, WORD), (1, 1))

    def word(where: np.ndarray, length: np.ndarray) -> np.ndarray:
        packed = np.ascontiguousarray(at_byte[where]).view(">u8").ravel().astype(np.uint64)
        return packed >> (np.uint64(8) * (WORD - length).astype(np.uint64)) \
            << (np.uint64(8) * (WORD - length).astype(np.uint64))

    short, middle = size <= WORD, (size > WORD) & (size <= 2 * WORD)
    yield SHORT, group[doc[short]], [word(start[short], size[short])], doc[short] + first_doc
    yield MIDDLE, group[doc[middle]], [word(start[middle], np.full(int(middle.sum()), WORD)),
                                       word(start[middle] + WORD, size[middle] - WORD)], \
        doc[middle] + first_doc
    rest = size > 2 * WORD
    body = lowered.tobytes()
    yield LONG, group[doc[rest]], [body[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist())], \
        doc[rest] + first_doc
