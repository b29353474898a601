"""Phrase collocations by weighted acyclic automata.

Each task runs its texts through one shard a language: words become numbers, and the
sequences of one to three words within a piece are sorted and counted.  When the shard is
full, its sorted sequences become a count transducer (:mod:`count_transducer`), cut into
segments at the bounds of prefix ranges.  A range's task takes the union of all shards'
segments, weights summed, and keeps the sequences that are frequent enough; the rest
cannot be part of a frequent phrase.  These automata are stored, one per language and range.

A phrase's parts lie in other ranges.  Each range asks for the distinct parts of its
phrases by automata without weights, one per range that holds them; there they are composed with the
count transducer and go back weighted.  So a part shared by very many phrases is asked
for once a range, and no task sees a hot word's phrases together.

Bounds of ranges are quantiles of distinct sequences drawn from about ``SAMPLE_DOCS``
texts; they decide where work is done, never a result.

Defined cases: a null text is empty, a null language is ``und``; a text without words adds
nothing; repeated rows count each; null ids and other columns are not read; an empty
table gives no rows.  A shard that fills up within a piece goes on in the next shard with
the last two words as context, so no sequence is lost or counted twice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, rows_of, slices, store, whole_text
from staylens.llm.count_transducer import MAX_WORDS, CountTransducer, counted, key, parts

LEAST = 10              # occurrences of a candidate
SHARE = 50              # per cent of a candidate's occurrences that lie in a longer one
TOP = 2000              # rows of each language
SCALE = 1_000_000       # of the score
SHARD_TOKENS = 3_000_000
BLOCK_CHARS = 1 << 20
UNION_KEYS = 4_000_000
SAMPLE_DOCS = 3000

# The characters that end a piece, and those that end a word.
_PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
_TOKENS = re.compile(r"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+").findall
_EDGE = re.compile(r"[ \t.,;:!?\n-\r]").search
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

_ROW = pa.schema([("rng", pa.int32()), ("lang", pa.string()), ("kind", pa.int32()),
                  ("sender", pa.int32()), ("total", pa.int64()), ("auto", pa.binary())])
_ROW_DDL = "rng int, lang string, kind int, sender int, total long, auto binary"
_SCORED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()),
                     ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()),
                     ("score", pa.int64())])
_SCORED_DDL = "lang string, phrase string, words int, a long, l long, r long, score long"

Bound = tuple[str, str, str, str]       # language and up to three words


class WordNumbers(dict):
    """Numbers of tokens: 0 for the end of a piece, else those of the lower-cased words,
    from 1 in the order of their first occurrence."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        if token[0] in _PIECE_ENDS:
            number = 0
        else:
            low = token.lower() if token.isascii() else token.translate(_LOWER)
            number = self.words.setdefault(low, len(self.words) + 1)
        self[token] = number
        return number


class Shard:
    """Sequences of the texts of one language, until it is closed."""

    def __init__(self, context: list[str] = ()):
        self.numbers = WordNumbers()
        self.streams = [np.array([self.numbers[w] for w in context], dtype=np.uint64)]
        self.context = self.tokens = len(context)

    def add(self, tokens: list[str]) -> None:
        self.streams.append(np.fromiter(map(self.numbers.__getitem__, tokens),
                                        np.uint64, len(tokens)))
        self.tokens += len(tokens)

    @property
    def full(self) -> bool:
        return (self.tokens >= SHARD_TOKENS
                or len(self.numbers.words) > MAX_WORDS - BLOCK_CHARS)

    def tail(self) -> list[str]:
        """The last words, two at most, of the piece that is open."""
        words, out = list(self.numbers.words), []
        for stream in reversed(self.streams):
            for number in stream[:-3:-1].tolist():
                if not number or len(out) == 2:
                    return out[::-1]
                out.append(words[number - 1])
        return out[::-1]

    def close(self) -> CountTransducer:
        words = sorted(self.numbers.words)
        rank = np.zeros(len(words) + 1, dtype=np.uint64)
        rank[[self.numbers.words[w] for w in words]] = np.arange(1, len(words) + 1)
        stream = np.concatenate(self.streams)
        self.streams = []
        stream = rank[stream.astype(np.int64)]
        keys = np.empty(3 * len(stream), dtype=np.uint64)
        size = 0
        for n in (1, 2, 3):         # sequences of context alone were counted before
            ends = len(stream) - n + 1
            first = max(0, self.context - n + 1)
            if ends > first:
                columns = [stream[first + i:ends + i] for i in range(n)]
                whole = np.logical_and.reduce([c > 0 for c in columns])
                found = key(*(c[whole] for c in columns))
                keys[size:size + len(found)] = found
                size += len(found)
        return CountTransducer(words, *counted(keys[:size]))


def _blocks(text: str) -> Iterator[list[str]]:
    """The tokens of a text, about BLOCK_CHARS characters at a time."""
    at = 0
    while at < len(text):
        edge = _EDGE(text, at + BLOCK_CHARS) if len(text) - at > BLOCK_CHARS else None
        end = edge.start() if edge else len(text)
        yield _TOKENS(text, at, end)
        at = end


def shard_automata(texts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, CountTransducer]]:
    """(language, automaton) of the shards of (language, text) rows."""
    shards: dict[str, Shard] = {}
    for lang, text in texts:
        shard = shards.setdefault(lang, Shard())
        for block in _blocks(text):
            shard.add(block)
            if shard.full:
                tail = shard.tail()
                yield lang, shard.close()
                shard = shards[lang] = Shard(tail)
        shard.add(["."])                       # a text's end ends its last piece
        if sum(s.tokens for s in shards.values()) >= SHARD_TOKENS:
            for lang in list(shards):
                yield lang, shards.pop(lang).close()
    for lang in list(shards):
        yield lang, shards.pop(lang).close()


# --- ranges ---------------------------------------------------------------------------

def range_bounds(texts: DataFrame, n_ranges: int) -> list[Bound]:
    """At most ``n_ranges`` - 1 rising sequences that part the ranges, from a sample of
    texts chosen by their hash; words are cut to 40 characters there, and a text gives
    200 sequences at most, so a bounded number reaches the driver."""
    n = texts.count()
    chosen = texts.filter(F.shiftrightunsigned(F.xxhash64("text"), 12) / float(1 << 52)
                          < SAMPLE_DOCS / max(n, 1))
    schema = pa.schema([("lang", pa.string()), *((f"w{i}", pa.string()) for i in range(3))])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for lang, text in rows_of(batches, "lang", "text"):
                words = [t.translate(_LOWER)[:40] for t in _TOKENS(text)
                         if t[0] not in _PIECE_ENDS]
                step = max(50, len(words) // 200)
                for i in range(0, len(words), step):
                    yield lang, *words[i:i + 3], *[""] * (3 - len(words[i:i + 3]))

        yield from slices(rows(), schema)

    drawn = map_arrow(chosen, draw, "lang string, w0 string, w1 string, w2 string").distinct()
    found = sorted(tuple(r) for r in drawn.collect())
    cuts = {found[len(found) * i // n_ranges] for i in range(1, n_ranges)} if found else set()
    return sorted(cuts)


def _segments(lang: str, auto: CountTransducer, bounds: list[Bound]) -> Iterator[tuple]:
    """(range, segment) of an automaton, cut at the bounds."""
    first = bisect_right(bounds, (lang, "", "", ""))
    inside = [b for b in bounds[first:] if b[0] == lang]
    cuts = [0, *(auto.cut(b[1:]) for b in inside), len(auto.keys)]
    for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
        if end > start:
            yield first + i, auto.part(start, end)


def _by_range(rows: DataFrame, n: int) -> DataFrame:
    """Each range in one task, its languages one after the other, automata before questions."""
    return rows.repartitionById(n, "rng").sortWithinPartitions("rng", "lang", "kind", "sender")


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """((range, language), rows) of rows that come sorted; rows are read one at a time."""
    rows = (row for batch in batches for i in range(batch.num_rows)
            for row in rows_of([batch.slice(i, 1)], "rng", "lang", *names))
    for group, mine in groupby(rows, key=lambda r: r[:2]):
        yield group, (r[2:] for r in mine)


# --- counting -----------------------------------------------------------------------------

def frequent_sequences(texts: DataFrame, bounds: list[Bound], n_ranges: int,
                       least: int = LEAST) -> DataFrame:
    """Stored automata by language and range of the sequences of one to three words that
    occur ``least`` times; ``total`` is the number of all words whose range it is."""
    sent = texts.sparkSession.sparkContext.broadcast(bounds)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for lang, auto in shard_automata(rows_of(batches, "lang", "text")):
                for rng, part in _segments(lang, auto, sent.value):
                    yield rng, lang, 0, 0, 0, part.dumps()

        yield from slices(rows(), _ROW, size=16)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (rng, lang), segments in _groups(batches, "auto"):
                held, size = [], 0
                for (packed,) in segments:
                    held.append(CountTransducer.loads(packed))
                    size += len(held[-1].keys)
                    if len(held) > 1 and size > UNION_KEYS + 2 * len(held[0].keys):
                        held = [CountTransducer.union(held)]
                        size = len(held[0].keys)
                auto = CountTransducer.union(held)
                total = int(auto.counts[parts(auto.keys)[1] == 0].sum())
                yield rng, lang, 0, rng, total, auto.at_least(least).dumps()

        yield from slices(rows(), _ROW, size=16)

    segments = map_arrow(texts, shards, _ROW_DDL)
    return store(map_arrow(_by_range(segments, n_ranges), unite, _ROW_DDL), "phrase-automata")


# --- parts of phrases ---------------------------------------------------------------------

def _cuts(auto: CountTransducer):
    """Candidate positions, and per cut (positions, first parts, rest): keys of
    the automaton's own words."""
    a, b, c = parts(auto.keys)
    two, three = np.flatnonzero((b > 0) & (c == 0)), np.flatnonzero(c > 0)
    return [(two, key(a[two]), key(b[two])),
            (three, key(a[three]), key(b[three], c[three])),
            (three, key(a[three], b[three]), key(c[three]))]


def _weigh(auto: CountTransducer, got: CountTransducer) -> dict[int, tuple[int, int, int]]:
    """The lowest-scoring cut, (score, l, r), by candidate position; of equal scores the
    shorter first part.  Python's integers: products pass 64 bits."""
    number = {w: i for i, w in enumerate(got.words, 1)}
    to = np.array([0, *(number.get(w, 0) for w in auto.words)], dtype=np.uint64)

    def count(keys: np.ndarray) -> np.ndarray:
        mapped = key(*(to[p.astype(np.int64)] for p in parts(keys)))
        there = np.searchsorted(got.keys, mapped)
        if not np.array_equal(got.keys[there], mapped):
            raise ValueError("a part of a phrase has no count")
        return got.counts[there].astype(object)

    best: dict[int, tuple[int, int, int]] = {}
    for at, first, rest in _cuts(auto):
        left, right = count(first), count(rest)
        score = SCALE * auto.counts[at].astype(object) ** 2 // (left * right)
        for i, one in zip(at.tolist(), zip(score.tolist(), left.tolist(), right.tolist())):
            if i not in best or one[0] < best[i][0]:
                best[i] = one
    return best


def scored_phrases(autos: DataFrame, bounds: list[Bound], n_ranges: int) -> DataFrame:
    """Stored candidates: lang, phrase, words, a, l, r, score."""
    sent = autos.sparkSession.sparkContext.broadcast(bounds)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (rng, lang), mine in _groups(batches, "auto"):
                auto = CountTransducer.union(CountTransducer.loads(p) for (p,) in mine)
                asked = np.unique(np.concatenate(
                    [k for _, first, rest in _cuts(auto) for k in (first, rest)]))
                asked = CountTransducer(auto.words, asked, np.ones(len(asked), np.int64))
                for to, part in _segments(lang, asked, sent.value):
                    yield to, lang, 1, rng, 0, part.dumps()

        yield from slices(rows(), _ROW, size=64)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (_, lang), mine in _groups(batches, "kind", "sender", "auto"):
                auto = None
                for kind, sender, packed in mine:
                    one = CountTransducer.loads(packed)
                    if kind == 0:
                        auto = one
                    else:
                        yield sender, lang, 1, 0, 0, auto.compose(one).dumps()

        yield from slices(rows(), _ROW, size=64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (_, lang), mine in _groups(batches, "kind", "auto"):
                auto, got = None, []
                for kind, packed in mine:
                    one = CountTransducer.loads(packed)
                    if kind == 0:
                        auto = one
                    else:
                        got.append(one)
                if not got:
                    continue
                best = _weigh(auto, CountTransducer.union(got))
                names, sizes = auto.sequences(), 1 + sum(p > 0 for p in parts(auto.keys)[1:])
                for i, (score, left, right) in best.items():
                    yield lang, names[i], int(sizes[i]), int(auto.counts[i]), left, right, score

        yield from slices(rows(), _SCORED, size=20_000)

    asked = map_arrow(autos.select("rng", "lang", "auto"), ask, _ROW_DDL)
    answers = map_arrow(_by_range(autos.union(asked), n_ranges), answer, _ROW_DDL)
    return store(map_arrow(_by_range(autos.union(answers), n_ranges), weigh, _SCORED_DDL),
                 "phrase-scores")


# --- ranking ----------------------------------------------------------------------------

def without_inner(scored: DataFrame, share: int = SHARE) -> DataFrame:
    """The candidates that lie in no longer one with ``share`` per cent of their
    occurrences; two-word phrases meet the three-word ones as their first and last words."""
    word = F.split("phrase", " ")
    longer = (scored.filter("words = 3")
              .select("lang", "a", F.explode(F.array(*(
                  F.concat_ws(" ", word[i], word[i + 1]) for i in (0, 1)))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    return (scored.join(longer, ["lang", "phrase"], "left")
            .filter("longer is null or words > 2 or cast(longer as decimal(20)) * 100 < "
                    f"cast(a as decimal(20)) * {share}").drop("longer"))


def top_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` rows with their rank; rows are dealt by the phrase's
    hash and every part keeps its first, then ever fewer parts are ranked together."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ways = 4 * n
    while ways > 1:
        ways = max(1, ways // 4)
        place = F.pmod(F.xxhash64("phrase"), F.lit(ways))
        window = Window.partitionBy("lang", "place").orderBy(*order)
        scored = (scored.withColumn("place", place)
                  .withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top))
    return scored.withColumn("rank", F.col("rank").cast("long")).drop("place")


def mine_phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE,
                 top: int = TOP) -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank, phrase, a, l,
    r, n, score."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
                        whole_text().alias("text"))
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(texts, n_ranges)
    autos = frequent_sequences(texts, bounds, n_ranges, least)
    scored = scored_phrases(autos, bounds, n_ranges)
    totals = autos.groupBy("lang").agg(F.sum("total").alias("n"))
    return (top_phrases(without_inner(scored, share), top).join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')),
                                  '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
sequences AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
  FROM pieces, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM sequences GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, cut, array_to_string(p[1:cut], ' ') AS head,
         array_to_string(p[cut + 1:c.k], ' ') AS tail
  FROM (SELECT *, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS cut
        FROM counts WHERE k > 1 AND f >= 10) c),
scored AS (
  SELECT c.*, h.f AS l, t.f AS r,
         ((1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head
              JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (
           PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_pairs AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase
    FROM (SELECT lang, a, string_split(phrase, ' ') AS p FROM best WHERE k = 3))
  GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang
                                 ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_pairs i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE b.k = 3 OR longer IS NULL OR 100 * longer < 50 * a)
SELECT r.lang, rank, phrase, a, l, r.r, n, score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
