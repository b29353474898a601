"""Katz backoff language model: learning, stored tables, and scores of whole texts.

Tokens are words cut at ASCII white space, A-Z lower-cased, and one end per document.
For a seen bigram, p(w | h) = d(c) c(h w) / c(h) with the Good-Turing discount d(c) of
counts up to 5; otherwise p(w | h) = bow(h) p(w), where bow(h) is exactly the mass that
the discounts leave over the unigram mass of the words not seen after h, so that the
probabilities after every h sum to one.  The first word's history is the document's
start.  Unigrams are discounted alike; what they leave is the probability of the
unknown word.  A history without a discounted count leaves T / (c(h) + T) instead, T
being the number of its different successors.

All counting and lookup runs over dictionary-coded blocks (:mod:`staylens.llm.blocks`):

1. Each block asks for its words by bucket; a bucket counts its words over the
   training documents, numbers them, stores its part of the unigram table, and
   answers the blocks.
2. Each block asks for its bigrams by bucket of the history.  Histories that hold
   more than ``HOT_SHARE`` of the tokens (and over ``HOT_LEAST``) are dealt out by the
   whole bigram, so no bucket holds a hot word; there are at most 1 / ``HOT_SHARE`` of
   these, and their sums meet in a small broadcast table.  A bucket stores its part of
   the bigram table, and answers with counts, and with the sums behind bow(h) where a
   block holds an unseen bigram.
3. Each block puts the answers in place and sums its documents' scores.

Defined cases: a null text counts as empty and has the end only; a null id is in
training (its crc32 counts as that of empty text); repeated rows count as often as
they stand; without any training document every probability is that of the unknown
word, 1, and the base score has N = V = 0; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import blocks as bl
from staylens.llm.common import id_remainder, map_arrow, rows_of, slices, store, whole_text

HELD_OUT = 2
K = 5                       # counts above K are not discounted
HOT_SHARE = 1e-5
HOT_LEAST = 100_000
BUCKET_TOKENS = 1_000_000

_TABLE = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("block", pa.int64()),
                    ("at", pa.binary()), ("answer", pa.binary()), ("more", pa.binary()), ("n", pa.int64()),
                    ("hist", pa.list_(pa.int64()))])
_TABLE_DDL = ("kind string, bucket long, block long, at binary, answer binary, more binary, n long, "
              "hist array<long>")
_ASK = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("at", pa.binary()),
                  ("ask", pa.binary()), ("counts", pa.binary())])
_ASK_DDL = "bucket long, block long, at binary, ask binary, counts binary"


def join_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 4], "little")
        out.append(data[at + 4:at + 4 + n])
        at += 4 + n
    return out


def tokens(text: str) -> list[bytes]:
    """Lower-cased words, then the end (empty)."""
    out = text.encode().lower().split()
    out.append(b"")
    return out


def good_turing(hist: np.ndarray) -> np.ndarray:
    """Discount factors of the counts 1..K from the numbers of types with 1..K+1
    occurrences; where the estimates are out of order, absolute discounting with
    D = n1 / (n1 + 2 n2)."""
    n = np.array(hist, dtype=float)
    r = np.arange(1, K + 1)
    if (n > 0).all():
        cut = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - cut) / (1 - cut) if cut < 1 else np.zeros(K)
        if ((d > 0) & (d < 1)).all():
            return d
    floor = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return (r - min(max(floor, 0.1), 0.9)) / r


def histogram(counts: np.ndarray) -> list[int]:
    """Numbers of types with 1..K+1 occurrences."""
    return [int((counts == r).sum()) for r in range(1, K + 2)]


@dataclass(frozen=True)
class Level:
    """Discounted shares of one order: ``d`` by count 1..K."""

    d: np.ndarray

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        """d(c) c."""
        factor = np.append(self.d, 1.0)
        at = np.clip(counts, 1, K + 1).astype(int) - 1
        return np.where(counts > 0, factor[at] * counts, 0.0)

    def left(self, hist: np.ndarray) -> np.ndarray:
        """Count mass taken by discounts, from numbers of types by count 1..K."""
        return hist @ (np.arange(1, K + 1) * (1 - self.d))


@dataclass(frozen=True)
class Unigrams:
    """Unigram probabilities by count, and what the blocks need to number words."""

    level: Level
    total: int              # N
    types: int              # V
    docs: int               # training documents
    hist: tuple[int, ...]
    offsets: np.ndarray     # first word number of each bucket
    size: int               # numbered words
    hot_least: int = HOT_LEAST

    @property
    def hot(self) -> float:
        return max(HOT_SHARE * self.total, self.hot_least)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """p(w) by training count; count 0 is the unknown word."""
        if not self.total:
            return np.ones(len(counts))
        left = float(self.level.left(np.array(self.hist[:K], dtype=float)))
        seen = self.level.discounted(counts) / self.total
        if left > 0:
            return np.where(counts > 0, seen, left / self.total)
        keep = self.total / (self.total + self.types)
        return np.where(counts > 0, seen * keep, 1 - keep)


# --- unigrams ---------------------------------------------------------------------------

def _ask_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """Requests with each word's training count in the block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for block, flags, lens, codes, words in rows_of(
                    batches, "block", "flags", "lens", "codes", "words"):
                words = bl.unpack_words(words)
                learn = np.repeat(np.array(flags, dtype=bool), lens)
                counts = np.bincount(bl.unpack_ints(codes)[learn], minlength=len(words))
                for bucket, part in bl.by_bucket(bl.buckets_of(words, buckets)):
                    yield (bucket, block, bl.pack_rising(part),
                           bl.pack_words([words[i] for i in part.tolist()]),
                           bl.pack_ints(counts[part]))

        yield from slices(rows(), _ASK, size=64)

    return map_arrow(blocks.select("block", "flags", "lens", "codes", "words"), ask, _ASK_DDL)


def _count_words(table: pa.Table) -> pa.Table:
    """A bucket's words: numbered by falling count, then by the word."""
    asked = [(block, at, bl.unpack_words(words), bl.unpack_ints(counts))
             for block, at, words, counts in rows_of([table], "block", "at", "ask", "counts")]
    bucket = table.column("bucket")[0].as_py()
    total: dict[bytes, int] = {}
    for _, _, words, counts in asked:
        for w, n in zip(words, counts.tolist()):
            total[w] = total.get(w, 0) + n
    listed = sorted(total, key=lambda w: (-total[w], w))
    number = {w: i for i, w in enumerate(listed)}
    sums = np.array([total[w] for w in listed])
    out = [("gram", bucket, None, None, bl.pack_words(listed), bl.pack_ints(sums), len(listed),
            [*histogram(sums), int((sums > 0).sum()), int(sums.sum())])]
    for block, at, words, _ in asked:
        mine = np.array([number[w] for w in words])
        out.append(("answer", bucket, block, at, bl.pack_ints(mine), bl.pack_ints(sums[mine]),
                    None, None))
    return _arrow(out)


def _arrow(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches(slices(rows, _TABLE, size=1 << 30, weight=1 << 40), _TABLE)


def _unigrams(grams: DataFrame, n_buckets: int, docs: int, hot_least: int) -> Unigrams:
    """Sums over the buckets; the driver gets one row of numbers per bucket."""
    rows = grams.select("bucket", "n", "hist").collect()
    sizes = np.zeros(n_buckets, dtype=np.int64)
    hist = np.zeros(K + 3, dtype=np.int64)
    for r in rows:
        sizes[r["bucket"]] = r["n"]
        hist += np.array(r["hist"])
    return Unigrams(Level(good_turing(hist[:K + 1])), int(hist[K + 2]), int(hist[K + 1]), docs,
                    tuple(hist[:K + 1].tolist()), np.cumsum(sizes) - sizes, int(sizes.sum()),
                    hot_least)


# --- bigrams ----------------------------------------------------------------------------

class BlockGrams:
    """A block's tokens as word numbers, and its distinct bigrams in order."""

    def __init__(self, lens, codes, n_words, answers, uni: Unigrams):
        number = np.zeros(n_words, dtype=np.int64)
        count = np.zeros(n_words, dtype=np.int64)
        for a in answers:
            at = bl.unpack_rising(a["at"])
            number[at] = bl.unpack_ints(a["answer"]) + uni.offsets[a["bucket"]]
            count[at] = bl.unpack_ints(a["more"])
        codes = bl.unpack_ints(codes)
        lens = np.array(lens, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(lens)), lens)
        self.token_count = count[codes]
        start = uni.size                    # the history before a document's first word
        word = number[codes]
        history = np.empty_like(word)
        history[1:] = word[:-1]
        history_count = np.empty_like(word)
        history_count[1:] = self.token_count[:-1]
        firsts = np.cumsum(lens) - lens
        history[firsts] = start
        history_count[firsts] = uni.docs
        m = start + 1
        if m * m < 1 << 63:
            order = np.argsort(history * m + word, kind="stable")
        else:
            order = np.lexsort((word, history))
        h, w = history[order], word[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        self.gram = np.empty(len(order), dtype=np.int64)     # of each token
        self.gram[order] = np.cumsum(new) - 1
        self.h, self.w = h[new], w[new]
        self.h_count = history_count[order][new]
        self.w_count = self.token_count[order][new]

    def buckets(self, n: int, hot: float) -> np.ndarray:
        """The bucket of each bigram: by the history, of a hot one by the whole bigram."""
        step = np.uint64(0x9E3779B97F4A7C15)
        key = self.h.astype(np.uint64) * step
        spread = (self.w.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        key = np.where(self.h_count > hot, key ^ spread, key)
        key = (key ^ (key >> np.uint64(31))) * step
        return ((key >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def pack_pairs(h: np.ndarray, w: np.ndarray) -> bytes:
    """Sorted pairs as differences."""
    dh = np.diff(h, prepend=0)
    dw = np.where(np.append(False, dh[1:] == 0), np.diff(w, prepend=0), w)
    return join_parts(bl.pack_ints(dh), bl.pack_ints(dw))


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    dh, dw = map(bl.unpack_ints, split_parts(data))
    h = np.cumsum(dh)
    new = np.append(True, dh[1:] != 0) if len(dh) else np.zeros(0, bool)
    run = np.cumsum(dw)
    first = np.flatnonzero(new)
    before = np.where(first > 0, run[first - 1], 0)
    return h, run - np.repeat(before, np.diff(np.append(first, len(dw))))


_GRAM_FIELDS = ("block", "flags", "lens", "codes", "n_words", "words_at")


def _ask_bigrams(full: DataFrame, uni: Unigrams, buckets: int) -> DataFrame:
    sent = full.sparkSession.sparkContext.broadcast(uni)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for block, flags, lens, codes, n_words, got in rows_of(batches, *_GRAM_FIELDS):
                uni = sent.value
                grams = BlockGrams(lens, codes, n_words, got or [], uni)
                learn = np.repeat(np.array(flags, dtype=bool), lens)
                counts = np.bincount(grams.gram[learn], minlength=len(grams.h))
                hot = grams.h_count > uni.hot
                for bucket, part in bl.by_bucket(grams.buckets(buckets, uni.hot)):
                    yield (bucket, block, None, pack_pairs(grams.h[part], grams.w[part]),
                           join_parts(bl.pack_ints(counts[part]),
                                      bl.pack_ints(grams.w_count[part]),
                                      bl.pack_ints(hot[part])))

        yield from slices(rows(), _ASK, size=64)

    return map_arrow(full.select(*_GRAM_FIELDS), ask, _ASK_DDL)


def _bigram_counter(sent):
    """The bucket task: counts, the sums behind bow(h), answers to the blocks."""

    def count(table: pa.Table) -> pa.Table:
        uni = sent.value
        asked = []
        for block, bucket, pairs, counts in rows_of([table], "block", "bucket", "ask", "counts"):
            asked.append((block, bucket, *unpack_pairs(pairs),
                          *map(bl.unpack_ints, split_parts(counts))))
        h, w, n, lower, hot = (np.concatenate([a[i] for a in asked]) for i in range(2, 7))
        order = np.lexsort((w, h))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        gram = np.empty(len(order), dtype=np.int64)
        gram[order] = np.cumsum(new) - 1
        first = order[new]
        h1, w1, hot1 = h[first], w[first], hot[first] > 0
        c = np.bincount(gram, weights=n).astype(np.int64)
        below = np.where(c > 0, uni.probability(lower[first]), 0.0)
        # sums by history: successors, successors by count 1..K, their unigram mass
        fresh = np.ones(len(h1), dtype=bool)
        fresh[1:] = h1[1:] != h1[:-1]
        place = np.cumsum(fresh) - 1
        size = int(place[-1]) + 1
        types = np.bincount(place, weights=c > 0, minlength=size).astype(np.int64)
        small = np.stack([np.bincount(place, weights=c == r, minlength=size)
                          for r in range(1, K + 1)], axis=1).astype(np.int64)
        mass = np.bincount(place, weights=below, minlength=size)
        hot_h = hot1[fresh]
        bucket = asked[0][1]
        seen = c > 0
        out = [("gram", bucket, None, None, pack_pairs(h1[seen], w1[seen]), bl.pack_ints(c[seen]),
                int(seen.sum()), histogram(c))]
        for i in np.flatnonzero(hot_h).tolist():
            out.append(("hot", bucket, int(h1[fresh][i]), None, None, np.float64(mass[i]).tobytes(),
                        int(types[i]), small[i].tolist()))
        at = 0
        for block, bucket, own_h, *_ in asked:
            mine = gram[at:at + len(own_h)]
            at += len(own_h)
            counts = c[mine]
            histories = place[mine]
            firsts = np.append(True, histories[1:] != histories[:-1])
            listed = histories[firsts]
            unseen = np.bincount(np.cumsum(firsts) - 1, weights=counts == 0,
                                 minlength=len(listed)) > 0
            plain = (small[listed].sum(axis=1) == 0) & ~hot_h[listed]
            wanted = listed[unseen & ~hot_h[listed]]
            out.append(("answer", bucket, block, None, bl.pack_ints(counts), join_parts(
                bl.pack_ints(np.where(plain, types[listed], 0)), bl.pack_ints(types[wanted]),
                *(bl.pack_ints(small[wanted, r]) for r in range(K)), mass[wanted].tobytes()),
                None, None))
        return _arrow(out)

    return count


# --- scores -----------------------------------------------------------------------------

def _log_probabilities(grams: BlockGrams, at: np.ndarray, answers, uni: Unigrams, level: Level,
                       hot: dict) -> np.ndarray:
    """log10 p(w | h) of the block's bigrams."""
    p = np.zeros(len(grams.h))
    mine_of = dict(bl.by_bucket(at))
    for a in answers:
        mine = mine_of[a["bucket"]]
        c = bl.unpack_ints(a["answer"])
        plain, types, *rest = split_parts(a["more"])
        plain, types = bl.unpack_ints(plain), bl.unpack_ints(types)
        small = np.stack([bl.unpack_ints(x) for x in rest[:K]], axis=1)
        mass = np.frombuffer(rest[K], np.float64)
        h, total = grams.h[mine], grams.h_count[mine].astype(float)
        lower = uni.probability(grams.w_count[mine])
        firsts = np.append(True, h[1:] != h[:-1])
        place = np.cumsum(firsts) - 1
        n = len(plain)
        is_hot = grams.h_count[mine][firsts] > uni.hot
        unseen = np.bincount(place, weights=c == 0, minlength=n) > 0
        all_types, all_small = plain.copy(), np.zeros((n, K), dtype=np.int64)
        all_mass = np.zeros(n)
        told = np.flatnonzero(unseen & ~is_hot)
        all_types[told], all_small[told], all_mass[told] = types, small, mass
        for k in np.flatnonzero(is_hot).tolist():
            all_types[k], all_small[k], all_mass[k] = hot[int(h[firsts][k])]
        whole = total[firsts]
        no_discount = np.where(is_hot, all_small.sum(axis=1) == 0, plain > 0)
        keep = np.where(no_discount, whole / np.maximum(whole + all_types, 1), 1.0)
        left = np.where(no_discount, 1 - keep, level.left(all_small) / np.maximum(whole, 1))
        bow = np.where(whole > 0, left / np.maximum(1 - all_mass, 1e-300), 1.0)
        seen = level.discounted(c) / np.maximum(total, 1) * keep[place]
        p[mine] = np.where(c > 0, seen, bow[place] * lower)
    return np.log10(p)


def score_documents(docs: DataFrame, hot_least: int = HOT_LEAST,
                    bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score."""
    flagged = docs.select("doc_id", whole_text().alias("text"),
                          (id_remainder("doc_id", 7) != HELD_OUT).alias("flag"))
    blocks = bl.word_blocks(flagged, lambda: tokens, "katz-blocks")
    n_docs = blocks.select(F.aggregate(
        "flags", F.lit(0).cast("long"), lambda n, f: n + f.cast("long")).alias("n")).agg(
        F.sum("n")).first()[0] or 0
    n_tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    word_buckets = bl.n_buckets(blocks)
    words = store(bl.answer(_ask_words(blocks, word_buckets), _count_words, _TABLE_DDL),
                  "katz-unigrams", ("kind",))
    uni = _unigrams(words.filter("kind = 'gram'"), word_buckets, n_docs, hot_least)

    full = _joined(blocks, words, "words_at")
    buckets = max(1, -(-n_tokens // bucket_tokens))
    sent = docs.sparkSession.sparkContext.broadcast(uni)
    pairs = store(bl.answer(_ask_bigrams(full, uni, buckets),
                            _bigram_counter(sent), _TABLE_DDL), "katz-bigrams", ("kind",))
    hist = np.zeros(K + 1, dtype=np.int64)
    for r in pairs.filter("kind = 'gram'").select("hist").collect():
        hist += np.array(r["hist"])
    level = Level(good_turing(hist))
    hot = _hot_histories(pairs)
    return _score_blocks(_joined(full, pairs, "pairs_at"), uni, level, hot, buckets)


def _joined(blocks: DataFrame, table: DataFrame, name: str) -> DataFrame:
    gathered = (table.filter("kind = 'answer'").groupBy("block")
                .agg(F.collect_list(F.struct("bucket", "at", "answer", "more")).alias(name)))
    return blocks.join(gathered, "block", "left")


def _hot_histories(pairs: DataFrame) -> dict:
    """Sums of the hot histories over the buckets; at most 1 / HOT_SHARE rows reach the
    driver.  Masses are added in the order of the buckets."""
    summed = (pairs.filter("kind = 'hot'").groupBy("block")
              .agg(F.sum("n").alias("n"),
                   F.array(*(F.sum(F.col("hist")[i]) for i in range(K))).alias("hist"),
                   F.array_sort(F.collect_list(F.struct("bucket", "more"))).alias("parts")))
    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()),
                        ("hist", pa.list_(pa.int64())), ("mass", pa.float64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from slices(((block, n, hist, sum(
            float(np.frombuffer(p["more"], np.float64)[0]) for p in parts))
            for block, n, hist, parts in rows_of(batches, "block", "n", "hist", "parts")), schema)

    rows = map_arrow(summed, add, "block long, n long, hist array<long>, mass double").collect()
    return {r["block"]: (r["n"], np.array(r["hist"]), r["mass"]) for r in rows}


def _score_blocks(full: DataFrame, uni: Unigrams, level: Level, hot: dict,
                  buckets: int) -> DataFrame:
    sent = full.sparkSession.sparkContext.broadcast((uni, level, hot))
    fields = ("doc_ids", "flags", "lens", "codes", "n_words", "words_at", "pairs_at")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()),
                        ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                        ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, level, hot = sent.value
        for doc_ids, flags, lens, codes, n_words, words_at, pairs_at in rows_of(batches, *fields):
            grams = BlockGrams(lens, codes, n_words, words_at or [], uni)
            logs = _log_probabilities(grams, grams.buckets(buckets, uni.hot), pairs_at or [],
                                      uni, level, hot)
            c = grams.token_count
            base = np.log10((c + 1) / (uni.total + 1 * (uni.types + 1)))
            n = len(doc_ids)

            def total(values):
                return np.bincount(grams.owner, weights=values, minlength=n)

            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([not f for f in flags], pa.bool_()),
                 pa.array(lens, pa.int64()), pa.array(total(c > 0).astype(np.int64)),
                 pa.array([uni.total] * n, pa.int64()), pa.array(total(base)),
                 pa.array(total(logs[grams.gram]))], schema=schema)

    return map_arrow(full.select(*fields), score,
                     "doc_id long, held_out boolean, n_tokens long, n_known long, "
                     "train_tokens long, base_score double, score double")
