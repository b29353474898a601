"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.  A document
is the sequence of its five-word shingles, each labelled with its occurrence number,
so that every element is unique (a document of fewer words is one shingle).  Two
documents are linked if their alignment similarity is at least 0.8: with c the most
shingles that both hold in the same order, c / (n1 + n2 - c).  It is the Jaccard
similarity of the labelled shingles wherever their order agrees.  Classes are the
connected components of the links.

A sketch takes the three smallest shingles under one hash function and keeps them in
the order of the text; equal sketches put documents into one bucket.  At similarity
0.8, 16 sketches miss a pair of long texts with probability near 1e-5, one of 8 and 10
shingles with 4.3e-5 and one of 4 and 5 with 2.8e-4.  In a first round one member
of each bucket, the first in an order of all documents, stands for it, and the others
are verified against it: no more pairs than members, and few different ones, since
the same document stands in all buckets of a group.  Members of the standing
document's class are not compared, and buckets of one class are closed.  In a second
round ``STANDING`` further members stand for each open bucket, the first in as many
other orders.  What is left are buckets of several classes: a closing pass takes their
members that have not stood, in blocks of about ``BLOCK``, and compares every block
with every other by parity prints (below).  Only pairs of different classes that the
prints cannot exclude leave the pass and are verified, so that every pair with an equal
sketch is decided, whatever the size of its bucket, and no group meets in one task.

A parity print has one bit per class of shingle hashes, set if a document holds an odd
number of them.  Shared shingles cancel out in the difference of two prints, so its set
bits are at most the shingles that only one of the two holds, of which similarity 0.8
allows (n1 + n2) / 9.  Excluding a pair by it is exact.

A pair is verified by aligning its shingle sequences within the band that similarity
0.8 allows: the longest increasing run of matched positions.

Documents with equal words are one node, so exact copies cost nothing.  Defined
cases: a null text counts as empty; a document without words is linked only to
documents of the same text; the document with the largest id stays, a null id being
the smallest; of rows equal in id and text one stays; an empty table gives no rows;
other columns never matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import (map_arrow, rows_of, slices, store, whole_text,
                                 without_marked)
from staylens.llm.components import components
from staylens.llm.decontaminate import words

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
SAMPLED = 3
STANDING = 4
BLOCK = 512
PRINT_BITS = 1 << 14
CACHE_WORDS = 300_000

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Labelled shingle hashes of word sequences; word hashes are kept between calls."""

    def __init__(self):
        self._cache: dict[bytes, int] = {}

    def __call__(self, seq: list[bytes]) -> np.ndarray:
        if not seq:
            return np.zeros(0, dtype=np.uint64)
        cache = self._cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(seq).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, seq), dtype=np.uint64, count=len(seq))
        n = min(SHINGLE, len(seq))
        s = h[:len(h) - n + 1].copy()
        for i in range(1, n):
            s = s * np.uint64(0x100000001B3) + h[i:len(h) - n + 1 + i]
        s = _mix(s)
        order = np.argsort(s, kind="stable")
        same = np.flatnonzero(s[order][1:] == s[order][:-1]) + 1
        if len(same):
            label = np.zeros(len(s), dtype=np.uint64)
            starts = np.ones(len(s), dtype=bool)
            starts[same] = False
            at = np.arange(len(s))
            label[order] = (at - np.maximum.accumulate(np.where(starts, at, 0))).astype(np.uint64)
            s = _mix(s + label * _STEP)
        return s


_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _STEP)


def order_sketches(shingles: np.ndarray) -> list[int]:
    """One number per sketch: the sampled shingles in the order of the text."""
    n = len(shingles)
    if not n:
        return []
    out = []
    rows = max(1, 200_000 // n)
    for first in range(0, SKETCHES, rows):
        seeds = _SEEDS[first:first + rows, None]
        h = _mix(shingles[None, :] ^ seeds)
        if n > SAMPLED:
            at = np.sort(np.argpartition(h, SAMPLED - 1, axis=1)[:, :SAMPLED], axis=1)
        else:
            at = np.broadcast_to(np.arange(n), (len(seeds), n))
        code = seeds[:, 0].copy()
        for i in range(at.shape[1]):
            code = _mix(code * _STEP + shingles[at[:, i]])
        out += code.view(np.int64).tolist()
    return out


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """c / (n1 + n2 - c) of two sequences of distinct elements; 0 if it is below
    ``least`` (then the alignment is not finished)."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2 or min(n1, n2) < least * max(n1, n2):
        return 0.0
    order = np.argsort(b)
    place = np.searchsorted(b, a, sorter=order)
    place = order[np.minimum(place, n2 - 1)]
    hit = np.flatnonzero(b[place] == a)
    # a similarity of at least ``least`` leaves that many elements unmatched at most
    band = (n1 + n2) * (1 - least) / (1 + least) + 1e-6
    there = place[hit]
    near = np.abs(there - hit) <= band
    there = there[near]
    c = len(there)
    if c < least * (n1 + n2 - c):
        return 0.0
    if c > 1 and (np.diff(there) <= 0).any():
        tails: list[int] = []
        for x in there.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        c = len(tails)
    found = c / (n1 + n2 - c)
    return found if found >= least else 0.0


def _node(text: str, seq: list[bytes]) -> bytes:
    return hashlib.md5(b"\x01" + b" ".join(seq) if seq else b"\x02" + text.encode()).digest()


_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_md5", pa.string()), ("node", pa.binary()),
                     ("size", pa.int64()), ("sketch", pa.list_(pa.int64()))])
_SKETCH_DDL = "doc_id long, text_md5 string, node binary, size long, sketch array<long>"


def sketch_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_md5, node, size, sketch) of every document, stored; ``size`` is the
    number of shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()

        def rows():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                seq = words(text)
                found = shingles(seq)
                yield (doc_id, hashlib.md5(text.encode()).hexdigest(), _node(text, seq),
                       len(found), order_sketches(found))

        yield from slices(rows(), _SKETCH, 4000)

    return store(map_arrow(docs.select("doc_id", whole_text().alias("text")), sketch,
                           _SKETCH_DDL), "near-sketches")


_BODY = pa.schema([("node", pa.binary()), ("body", pa.binary())])


def shingle_bodies(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, body) of the given nodes, stored: the shingles' hashes, 4 bytes each."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(), set()

        def rows():
            for (text,) in rows_of(batches, "text"):
                seq = words(text)
                if not seq or (node := _node(text, seq)) in seen:
                    continue
                if len(seen) < CACHE_WORDS:
                    seen.add(node)      # copies in one task leave it once
                yield node, shingles(seq).astype("<u4").tobytes()

        yield from slices(rows(), _BODY, 1000)

    made = map_arrow(docs.select(whole_text().alias("text")), bodies, "node binary, body binary")
    return store(made.join(nodes, "node").dropDuplicates(["node"]), "near-bodies")


def verified(pairs: DataFrame, bodies: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose alignment similarity is at least ``least``, stored."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for u, v, a, b in rows_of(batches, "u", "v", "a", "b"):
                if alignment_similarity(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), least):
                    yield u, v

        yield from slices(rows(), schema, 10_000)

    left = bodies.select(F.col("node").alias("u"), F.col("body").alias("a"))
    right = bodies.select(F.col("node").alias("v"), F.col("body").alias("b"))
    both = pairs.join(left, "u").join(right, "v")
    return store(map_arrow(both.select("u", "v", "a", "b"), align, "u binary, v binary"),
                 "near-links")


def parity_print(body: np.ndarray) -> bytes:
    """One bit per class of the 4-byte hashes, set if their number is odd; about four
    bits a shingle, a power of two, from 64 to ``PRINT_BITS``."""
    width = min(PRINT_BITS, max(64, 1 << (4 * len(body) - 1).bit_length()))
    odd = np.bincount(body & np.uint32(width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _prints(rows: list[tuple], width: int) -> np.ndarray:
    """The prints of one length as a matrix, folded to ``width`` bytes."""
    out = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    while out.shape[1] > width:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return np.ascontiguousarray(out).view(np.uint64)


def unexcluded_pairs(left: list[tuple], right: list[tuple],
                     least: float) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of members (node, size, class, print) of different classes, one of each
    list, that sizes and prints cannot exclude."""

    def by_length(rows):
        rows = sorted(rows, key=lambda r: len(r[3]))
        return [(n, list(g)) for n, g in groupby(rows, lambda r: len(r[3]))]

    for long_a, rows_a in by_length(left):
        for long_b, rows_b in by_length(right):
            width = min(long_a, long_b)
            a, b = _prints(rows_a, width), _prints(rows_b, width)
            size = np.array([r[1] for r in rows_b])
            names = {c: i for i, c in enumerate({r[2] for r in rows_b})}
            cls = np.array([names[r[2]] for r in rows_b])
            for (node, n, c, _), bits in zip(rows_a, a):
                at = np.flatnonzero((cls != names.get(c, -1))
                                    & (np.minimum(size, n) >= least * np.maximum(size, n)))
                apart = np.bitwise_count(b[at] ^ bits).sum(axis=1)
                allowed = (size[at] + n) * ((1 - least) / (1 + least)) + 1e-6
                for i in at[apart <= allowed].tolist():
                    other = rows_b[i][0]
                    if node != other:
                        yield min(node, other), max(node, other)


def remaining_pairs(members: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of members (bucket, node, size, stood, class) that share a bucket,
    have not stood, are of different classes and cannot be excluded."""
    left = members.filter(~F.col("stood")).drop("stood")
    open_ = (left.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"),
                                        F.count("*").alias("n"))
             .filter(F.col("low") != F.col("high"))
             .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    left = store(left.join(open_, "bucket"), "near-left")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from slices(((node, parity_print(np.frombuffer(body, "<u4")))
                           for node, body in rows_of(batches, "node", "body")),
                          pa.schema([("node", pa.binary()), ("print", pa.binary())]), 10_000)

    printed = map_arrow(bodies.join(left.select("node").distinct(), "node", "left_semi"),
                        prints, "node binary, print binary")
    dealt = (left.join(printed, "node")
             .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
             .repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            dealt_rows = rows_of(batches, "bucket", "lo", "hi", "block", "node", "size",
                                 "class", "print")
            for (_, lo, hi), met in groupby(dealt_rows, lambda r: r[:3]):
                met = list(met)
                first = [r[4:] for r in met if r[3] == lo]
                second = first if lo == hi else [r[4:] for r in met if r[3] == hi]
                yield from unexcluded_pairs(first, second, least)

        yield from slices(rows(), pa.schema([("u", pa.binary()), ("v", pa.binary())]), 10_000)

    columns = ["bucket", "lo", "hi", "block", "node", "size", "class", "print"]
    return map_arrow(dealt.select(*columns), compare, "u binary, v binary").distinct()


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(sketch rows, (node, class) of the nodes with a link)."""
    sketched = sketch_documents(docs)
    listed = sketched.select("node", "size", F.explode("sketch").alias("bucket")).distinct()
    shared = (listed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
              .select("bucket"))
    members = store(listed.join(shared, "bucket").withColumn("stood", F.lit(False)),
                    "near-members")
    bodies = shingle_bodies(docs, members.select("node").distinct())
    classes = None
    for turn in range(2):
        met = _meet(members, classes, turn)
        pairs = (met.filter((F.col("class") != F.col("rep.class"))
                            & (F.least("size", "rep.size")
                               >= least * F.greatest("size", "rep.size")))
                 .select(F.least("node", "rep.node").alias("u"),
                         F.greatest("node", "rep.node").alias("v")).distinct())
        classes = _merge(classes, verified(pairs, bodies, least))
        members = met.groupBy("bucket", "node", "size").agg(
            F.max(F.col("stood") | (F.col("node") == F.col("rep.node"))).alias("stood"))
    left = remaining_pairs(_with_class(members, classes), bodies, least)
    return sketched, _merge(classes, verified(left, bodies, least))


def _with_class(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return members.withColumn("class", F.col("node"))
    return (members.join(classes, "node", "left")
            .withColumn("class", F.coalesce("class", "node")))


def _meet(members: DataFrame, classes: DataFrame | None, turn: int) -> DataFrame:
    """The members of buckets of several classes, with their class and the bucket's
    standing member ``rep`` (node, size, class), stored."""
    known = _with_class(members, classes)
    orders = [F.col("node")] if turn == 0 else [
        F.md5(F.concat("node", F.lit(f"{turn}-{i}"))) for i in range(STANDING)]
    firsts = [F.min(F.when(~F.col("stood"), F.struct(o.alias("place"), F.struct(
        "node", "size", "class").alias("who"))))["who"] for o in orders]
    standing = (known.groupBy("bucket")
                .agg(F.array_compact(F.array_distinct(F.array(*firsts))).alias("reps"),
                     F.min("class").alias("low"), F.max("class").alias("high"))
                .filter(F.col("low") != F.col("high"))
                .select("bucket", F.explode("reps").alias("rep")))
    return store(known.join(standing, "bucket"), "near-met")


def _merge(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes after the new links."""
    if classes is None:
        return store(components(links), "near-classes")
    to = classes.select(F.col("node").alias("u"), F.col("class").alias("cu"))
    of = classes.select(F.col("node").alias("v"), F.col("class").alias("cv"))
    lifted = links.join(to, "u", "left").join(of, "v", "left").select(
        F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    merged = components(lifted).select(F.col("node").alias("class"), F.col("class").alias("to"))
    old = classes.join(merged, "class", "left").select(
        "node", F.coalesce("to", "class").alias("class"))
    new = merged.select(F.col("class").alias("node"), F.col("to").alias("class"))
    return store(old.unionByName(new.join(old, "node", "left_anti")), "near-classes")


def mark_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_md5, class, class_id, class_size, kept) by document: class_id is
    the id of the document that stays."""
    sketched, classes = near_classes(docs, least)
    named = (sketched.select("doc_id", "text_md5", "node").join(classes, "node", "left")
             .select("doc_id", "text_md5", F.coalesce("class", "node").alias("class")))
    rows = named.groupBy("class", "doc_id", "text_md5").agg(F.count("*").alias("copies"))
    stays = F.max(F.struct(F.col("doc_id").isNotNull().alias("real"), "doc_id", "text_md5"))
    groups = rows.groupBy("class").agg(stays.alias("stay"), F.sum("copies").alias("class_size"))
    nth = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")
    is_it = (F.col("doc_id").eqNullSafe(F.col("stay.doc_id"))
             & (F.col("text_md5") == F.col("stay.text_md5")) & (F.col("nth") == 1))
    return (rows.join(groups, "class")
            .select("doc_id", "text_md5", "class", "stay", "class_size", nth)
            .select("doc_id", "text_md5", "class", F.col("stay.doc_id").alias("class_id"),
                    "class_size", is_it.alias("kept")))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept."""
    return mark_near_copies(docs, least).select("doc_id", "class_id", "class_size", "kept")


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents that stay, with all their columns."""
    fates = (mark_near_copies(docs, least).groupBy("text_md5", "doc_id")
             .agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
             .filter(~F.col("kept") | (F.col("copies") > 1)))
    named = docs.withColumn("__md5", F.md5(whole_text().cast("binary")))
    return without_marked(named, "__md5", fates).select(*docs.columns)
