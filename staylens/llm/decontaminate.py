"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised (A-Z lower-cased, words of letters, digits and non-ASCII
bytes) and built into one automaton of all their word substrings.  A document's words
stream through it; the state and the longest matching length at each word tell which
items' windows end there: any ``window`` consecutive item words (the length limit),
or a whole item of fewer words (coverage of all of it).  Words inside a window are
hit.  Each worker builds the automaton from the broadcast items; its size is bounded
by dealing the items by hash into chunks of about ``chunk_bytes`` of text and
streaming the documents through one chunk's automaton after the other when there is
more than one.

Defined cases: a null text or item has no words; an item without words has no
window; repeated items count once by item_id, a null item_id counts as empty text;
an empty benchmark hits nothing; repeated documents are scored alike; other columns
never matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, rows_of, slices, store, whole_text

WINDOW = 10
CHUNK_BYTES = 600_000
DROP_COVERAGE = 0.5

# Lower-cases A-Z and blanks every ASCII byte that is neither letter nor digit.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else
               b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


class ItemAutomaton:
    """Suffix automaton of the items' word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: dict[int, set[str]] = {}            # of the state's window
        self.short: dict[int, dict[int, set[str]]] = {}  # length -> items ending there
        for _, seq in items:
            state = 0
            for word in seq:
                state = self._extend(state, word)
        for item, seq in items:
            self._mark(item, seq)
        self._least = self._least_hits()

    def _new(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state for ``state``'s longest string and ``word``, split off if needed."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        made = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._split(last, word)
        return made

    def _mark(self, item: str, seq: list[bytes]) -> None:
        n = min(len(seq), self.window)
        state = matched = 0
        for word in seq:
            state = self.next[state][word]
            matched += 1
            while matched > n:          # keep the state of the last n words
                matched -= 1
                if matched == self.length[self.link[state]]:
                    state = self.link[state]
            if matched == n:
                if n == self.window:
                    self.items.setdefault(state, set()).add(item)
                else:
                    self.short.setdefault(state, {}).setdefault(n, set()).add(item)

    def _least_hits(self) -> list[int]:
        """For each state, the least matching length at which something ends there."""
        least = [self.window] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            own = min(self.short.get(state, (self.window,)))
            least[state] = min(own, least[self.link[state]])
        return least

    def scan(self, seq: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit word ranges [start, end), merged, and the items whose windows occur."""
        moves, link, length, least = self.next, self.link, self.length, self._least
        window, spans, found = self.window, [], set()
        state = matched = 0
        for at, word in enumerate(seq, 1):
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = moves[state].get(word)
            if to is None:
                continue
            state = to
            matched += 1
            if matched >= least[state]:
                size = self._ending(state, matched, found)
                if size:
                    start = at - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at])
        return spans, found

    def _ending(self, state: int, matched: int, found: set[str]) -> int:
        """Adds the items with a window ending here; the length of the longest window."""
        size, window = 0, self.window
        while state > 0:
            for n, items in self.short.get(state, {}).items():
                if n <= matched:
                    size = max(size, n)
                    found |= items
            if matched >= window and self.length[self.link[state]] < window \
                    <= self.length[state]:
                size = window
                found |= self.items.get(state, set())
            state = self.link[state]
        return size


@lru_cache(maxsize=2)
def _automaton(items: tuple, window: int) -> ItemAutomaton:
    """One per worker process and chunk."""
    return ItemAutomaton([(i, list(seq)) for i, seq in items], window)


def item_chunks(items: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Items as ((item_id, words), ...) in chunks of about ``chunk_bytes`` of text."""
    plain = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                         whole_text().alias("text"))
    size = plain.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = max(1, math.ceil(size / chunk_bytes))
    dealt = plain.withColumn("c", F.pmod(F.xxhash64("item", "text"), F.lit(chunks)))
    for c in range(chunks):
        rows = dealt.filter(F.col("c") == c).select("item", "text").distinct().collect()
        yield tuple(sorted((r["item"], tuple(words(r["text"]))) for r in rows))


_HITS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.binary()), ("n_words", pa.int64()),
                   ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_HITS_DDL = ("doc_id long, text_hash binary, n_words long, spans array<array<long>>, "
             "items array<string>")


def _scan(docs: DataFrame, chunk: tuple, window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(chunk)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value, window)

        def rows():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                seq = words(text)
                spans, found = automaton.scan(seq)
                yield (doc_id, hashlib.md5(text.encode()).digest(), len(seq), spans,
                       sorted(found))

        yield from slices(rows(), _HITS)

    return map_arrow(docs, scan, _HITS_DDL)


def _union_spans(lists: F.Column) -> F.Column:
    """Ranges of several lists merged into disjoint ones, in order."""
    flat = F.array_sort(F.flatten(lists))
    empty = F.array().cast("array<array<bigint>>")

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.array(last[0], F.greatest(last[1], span[1]))
        return F.when(last[1] >= span[0],
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))) \
            .otherwise(F.concat(done, F.array(span)))

    return F.aggregate(flat, empty, add)


def match_items(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, spans (hit word ranges), items (sorted ids)."""
    plain = docs.select("doc_id", whole_text().alias("text"))
    chunks = list(item_chunks(items, chunk_bytes))
    if len(chunks) == 1:
        return _scan(plain, chunks[0], window).drop("text_hash")
    # equal rows give equal results in every chunk: merged once, returned as often
    merged = (store(_scan_all(plain, chunks, window), "decontaminate-chunks")
              .groupBy("doc_id", "text_hash", "n_words")
              .agg(F.collect_set("spans").alias("s"), F.collect_set("items").alias("i"),
                   F.count("*").alias("n")))
    copies = F.explode(F.sequence(F.lit(1), (F.col("n") / len(chunks)).cast("int"))).alias("nth")
    return merged.select("doc_id", "n_words", _union_spans(F.col("s")).alias("spans"),
                         F.array_sort(F.array_distinct(F.flatten("i"))).alias("items"),
                         copies).drop("nth")


def _scan_all(docs: DataFrame, chunks: list[tuple], window: int) -> DataFrame:
    """One row per document and chunk."""
    return _union_all([_scan(docs, chunk, window) for chunk in chunks])


def _union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return match_items(docs, items, window, chunk_bytes).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def cut_words(text: str, spans: list) -> str:
    """``text`` without the word ranges, which are disjoint and in order; a cut leaves a
    line break."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_PLAIN))]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at:places[start][0]])
        at = places[end - 1][1]
    return b"\n".join([*out, raw[at:]]).decode()


def cut_spans(text: str, automaton: ItemAutomaton, drop_coverage: float) -> str | None:
    """``text`` without hit spans, None if more than ``drop_coverage`` of its words were
    hit.  Cutting repeats until nothing is hit, since the words on both sides of a cut
    could form a new window."""
    total = hit = 0
    while True:
        seq = words(text)
        total = total or len(seq)
        spans = automaton.scan(seq)[0]
        if not spans:
            return text
        hit += sum(end - start for start, end in spans)
        if hit > drop_coverage * total:
            return None
        text = cut_words(text, spans)


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                         drop_coverage: float = DROP_COVERAGE,
                         chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents with contaminated spans cut out of their text, without those of
    which more than ``drop_coverage`` of the words are hit; all columns kept (n_chars
    follows the text).  Untouched documents come back as they are.  The result is the
    same for any ``chunk_bytes``."""
    chunks = list(item_chunks(items, chunk_bytes))
    if len(chunks) == 1:
        return _cut_chunk(docs, chunks[0], window, drop_coverage)
    return _cut_rounds(docs, chunks, window, drop_coverage)


def _cut_rounds(docs: DataFrame, chunks: list[tuple], window: int,
                drop_coverage: float) -> DataFrame:
    """``cut_spans`` for several chunks.  A round finds the spans of all chunks, unites
    them and cuts once; documents that were cut go into the next round with their first
    word count and the words hit so far."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.withColumns({"__total": F.lit(None).cast("long"),
                             "__hit": F.lit(0).cast("long")})
    clean = []
    while True:
        plain = left.select("doc_id", whole_text().alias("text"))
        hit = store(_scan_all(plain, chunks, window).filter(F.size("spans") > 0),
                    "decontaminate-hits")
        if hit.isEmpty():
            return _union_all([*clean, left.select(*names)])
        spans = (hit.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__md5"),
                             F.col("n_words").alias("__words"))
                 .agg(F.collect_set("spans").alias("s"))
                 .select("__id", "__md5", "__words", _union_spans(F.col("s")).alias("__spans")))
        same = (F.col("doc_id").eqNullSafe(F.col("__id"))
                & (F.unhex(F.md5(whole_text().cast("binary"))) == F.col("__md5")))
        clean.append(left.join(spans, same, "left_anti").select(*names))
        n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
        met = (left.join(spans, same)
               .withColumns({"__total": F.coalesce("__total", "__words"),
                             "__hit": F.col("__hit") + n_hit})
               .filter(F.col("__hit") <= F.lit(drop_coverage) * F.col("__total"))
               .select(*names, "__total", "__hit", "__spans"))
        cut = _cut_united(met).drop("__spans")
        if "n_chars" in docs.columns:
            cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        left = store(cut, "decontaminate-cut")


def _cut_united(met: DataFrame) -> DataFrame:
    """``met`` with the ranges of ``__spans`` cut out of its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(*row) for row in rows_of([batch], "text", "__spans")]
            field = batch.schema.field("text")
            yield batch.set_column(batch.schema.get_field_index("text"), field,
                                   pa.array(texts, type=field.type))

    return map_arrow(met, cut, met.schema)


def _cut_chunk(docs: DataFrame, chunk: tuple, window: int, drop_coverage: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(chunk)
    counted = "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value, window)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            kept, changed = [], {}
            for i, text in enumerate(texts):
                new = text if text is None else cut_spans(text, automaton, drop_coverage)
                if new is None and text is not None:
                    continue
                kept.append(i)
                if new is not text:
                    changed[i] = new
            if len(kept) == len(texts) and not changed:
                yield batch
                continue
            names = batch.schema.names
            columns = [c.take(pa.array(kept, pa.int64())) for c in batch.columns]
            at = names.index("text")
            columns[at] = pa.array([changed.get(i, texts[i]) for i in kept],
                                   type=batch.schema.field("text").type)
            if counted and changed:
                n = names.index("n_chars")
                sizes = [len(changed[i]) if i in changed else old
                         for i, old in zip(kept, columns[n].to_pylist())]
                columns[n] = pa.array(sizes, type=columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, cut, docs.schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
           translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
b AS (
  SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
           translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (
  SELECT doc_id, COUNT(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id
),
its AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
