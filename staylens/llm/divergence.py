"""Divergence of sources from each other and from their language, by length-bucketed packing.

Tasks count terms by (language, source) over the bytes of whole batches
(:mod:`packed_terms`) and send what they counted, packed, by bucket of the term's bytes.
A bucket's task adds up, one length class after the other, and keeps the terms with
enough documents in their language; a hot term arrives once a task and group.  The kept
counts are stored.

Smoothed shares are whole numbers of a thousand-millionth.  Pairs of sources are summed
over slices of about ``SLICE`` terms by blocks of ``BLOCK`` sources: terms that neither source
has add the same amount each, so a block's task only holds the terms that occur in it, and
each pair leaves one partial sum a slice.  All arithmetic is on whole numbers that fit
(shares are divided as decimals of 38 digits).

Defined cases: a null text, language or source is empty; every (language, source) that
occurs is a group, even without terms; a language without kept terms has pairs of value
0 and no terms; repeated rows are documents of their own; ids and other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, rows_of, ship_code, slices, store
from staylens.llm.packed_terms import LONG, MIDDLE, SHORT, TermCounts, occurrences, radix_order, \
    run_starts

LEAST_DOCS = 30         # documents of the language that hold a kept term
PRIOR = 5               # added to each count
SCALE = 1_000_000_000
TOP = 50                # terms of a group
FLUSH_TERMS = 4_000_000
MERGE_ROWS = 4_000_000
SLICE = 4096
BLOCK = 64
CHUNK = 1024            # terms held as a dense matrix at a time

_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()),
                   ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
                   ("data", pa.binary())])
_SENT_DDL = ("bucket int, kind int, langs array<string>, sources array<string>, data binary")
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                   ("c", pa.int64()), ("lang_c", pa.int64()), ("head", pa.int64())])
_KEPT_DDL = "lang string, source string, term string, c long, lang_c long, head long"
_SUMS_DDL = "lang string, i int, j int, part long"


class TermCounter:
    """Terms of batches of (lang, source, text), counted when many have come together."""

    def __init__(self, n_buckets: int):
        self.n_buckets = n_buckets
        self._reset()

    def _reset(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.found: dict[int, list[tuple]] = {SHORT: [], MIDDLE: [], LONG: []}
        self.size = self.docs = 0

    def add(self, batch: pa.RecordBatch) -> None:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        group = np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], np.uint64)
        for kind, *columns in occurrences(batch.column("text"), self.docs, group):
            if len(columns[0]):
                self.found[kind].append(columns)
                self.size += len(columns[0])
        self.docs += batch.num_rows

    def close(self) -> Iterator[tuple]:
        """Rows of _SENT of all that was counted."""
        groups = list(self.groups)
        for kind, found in self.found.items():
            if not found:
                continue
            group, words, doc = zip(*found)
            group, doc = np.concatenate(group), np.concatenate(doc)
            texts = None
            if kind == LONG:
                raw = [t for part in words for t in part]
                texts = sorted(set(raw))
                number = {t: i for i, t in enumerate(texts)}
                words = [np.array([number[t] for t in raw], dtype=np.uint64)]
            else:
                words = [np.concatenate(w) for w in zip(*words)]
            found.clear()
            counts = TermCounts.runs(group, words, doc, texts)
            bucket = counts.buckets(self.n_buckets)
            order = np.argsort(bucket, kind="stable")
            for rows in np.split(order, run_starts([bucket[order]])[1:]):
                part = counts.take(rows)
                used, part.group = np.unique(part.group, return_inverse=True)
                langs, sources = zip(*(groups[g] for g in used.tolist()))
                yield int(bucket[rows[0]]), kind, list(langs), list(sources), part.packed()
        self._reset()


def kept_counts(texts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Stored counts of the kept terms: lang, source, term, c, ``lang_c`` (in the whole
    language) and ``head`` (1 in one row of each language's term)."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            counter = TermCounter(n)
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    counter.add(batch.slice(first, 256))
                    if counter.size >= FLUSH_TERMS:
                        yield from counter.close()
            yield from counter.close()

        yield from slices(rows(), _SENT, size=64)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, size, now, groups = [], 0, None, {}
            single = (b.slice(i, 1) for b in batches for i in range(b.num_rows))
            for bucket, kind, langs, sources, data in rows_of(single, *_SENT.names):
                if (bucket, kind) != now:
                    yield from _kept_rows(held, groups, least_docs)
                    held, size, now, groups = [], 0, (bucket, kind), {}
                to = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources)],
                              np.uint64)
                part = TermCounts.unpacked(data, kind)
                part.group = to[part.group.astype(np.int64)]
                held.append(part)
                size += len(part.group)
                if len(held) > 1 and size > MERGE_ROWS + 2 * len(held[0].group):
                    held = [TermCounts.merged(held)]
                    size = len(held[0].group)
            yield from _kept_rows(held, groups, least_docs)

        yield from slices(rows(), _KEPT, size=20_000)

    sent = map_arrow(texts, count, _SENT_DDL).repartitionById(n, "bucket") \
        .sortWithinPartitions("bucket", "kind")
    return store(map_arrow(sent, unite, _KEPT_DDL), "divergence-kept")


def _kept_rows(held: list[TermCounts], groups: dict, least_docs: int) -> Iterator[tuple]:
    """Rows of _KEPT of one bucket and length class."""
    if not held:
        return
    counts = TermCounts.merged(held)
    names = list(groups)
    langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in names))}
    lang = np.array([langs[n[0]] for n in names], np.uint64)[counts.group.astype(np.int64)]
    order = radix_order([*counts.words, lang])
    counts, lang = counts.take(order), lang[order]
    start = run_starts([*counts.words, lang])
    size = np.diff(start, append=len(lang))
    kept = np.add.reduceat(counts.docs, start) >= least_docs
    total = np.repeat(np.add.reduceat(counts.count, start), size)
    head = np.zeros(len(lang), dtype=np.int64)
    head[start] = 1
    rows = np.flatnonzero(np.repeat(kept, size))
    for term, g, c, t, h in zip(counts.terms(rows), counts.group[rows].tolist(),
                                counts.count[rows].tolist(), total[rows].tolist(),
                                head[rows].tolist()):
        yield *names[g], term, c, t, h


def _share(count: str, total: str, terms: str):
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    return F.expr(f"1 + cast({count} + {PRIOR} as decimal(20)) * {SCALE} div "
                  f"({total} + {PRIOR} * {terms})")


def _groups(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group: lang, source, v (kept terms of the language), lang_n, n, ``at`` (its
    number within the language, sources in order) and ``blocks`` of the language."""
    langs = kept.groupBy("lang").agg(F.sum("head").alias("v"), F.sum("c").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    by_lang = Window.partitionBy("lang")
    return (texts.select("lang", "source").distinct()
            .join(langs, "lang", "left").join(own, ["lang", "source"], "left")
            .na.fill(0, ["v", "lang_n", "n"])
            .withColumn("at", F.row_number().over(by_lang.orderBy("source")) - 1)
            .withColumn("blocks", F.ceil(F.count("*").over(by_lang) / BLOCK).cast("int")))


def term_part(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Each group's terms whose share is above the language's, the first ``top``."""
    window = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return (kept.join(groups.filter("v > 0"), ["lang", "source"])
            .withColumn("value", _share("c", "n", "v") - _share("lang_c", "lang_n", "v"))
            .filter("value > 0")
            .select("lang", "source", F.lit("term").alias("part"),
                    F.col("term").alias("item"), F.col("value").cast("long").alias("value"))
            .withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top))


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value) of every two groups i < j of a language, by their numbers."""
    slices_ = F.greatest(F.lit(1), F.ceil(F.col("v") / SLICE)).cast("int")
    known = groups.withColumn("slices", slices_).withColumn(
        "p0", F.when(F.col("v") > 0, _share("0", "n", "greatest(v, 1)")).otherwise(0).cast("long"))
    block = (F.col("at") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def dealt(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("block", block).withColumn("other", other)
                .select("lang", "slice", F.least("block", "other").alias("lo"),
                        F.greatest("block", "other").alias("hi"), "term", "at", "p", "v"))

    terms = (kept.select("lang", "source", "term", "c").join(known, ["lang", "source"])
             .withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
             .withColumn("p", _share("c", "n", "v").cast("long")))
    marks = (known.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
             .withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("p0")))
    rows = dealt(terms).union(dealt(marks))
    ship_code(kept.sparkSession)

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        lang, slice_, lo, hi = (k.as_py() for k in key)
        is_mark = np.array(table.column("term").is_null())
        at, p = table.column("at").to_numpy(), table.column("p").to_numpy()
        mine = np.unique(at[is_mark])
        base = np.zeros(len(mine), dtype=np.int64)
        base[np.searchsorted(mine, at[is_mark])] = p[is_mark]
        term = table.column("term").combine_chunks().dictionary_encode().indices
        term = term.to_numpy(zero_copy_only=False)[~is_mark].astype(np.int64)
        column, share = np.searchsorted(mine, at[~is_mark]), p[~is_mark]
        left = np.flatnonzero(mine // BLOCK == lo)
        right = np.flatnonzero(mine // BLOCK == hi)
        apart = np.abs(base[left][:, None] - base[right][None, :])
        total = apart * (int(table.column("v")[0].as_py()) if slice_ == 0 else 0)
        order = np.argsort(term, kind="stable")
        term, column, share = term[order], column[order], share[order]
        n_terms = int(term[-1]) + 1 if len(term) else 0
        for first in range(0, n_terms, CHUNK):
            a, b = np.searchsorted(term, [first, first + CHUNK])
            dense = np.repeat(base[None, :], min(CHUNK, n_terms - first), axis=0)
            dense[term[a:b] - first, column[a:b]] = share[a:b]
            for nth, k in enumerate(left.tolist()):
                total[nth] += np.abs(dense[:, [k]] - dense[:, right]).sum(axis=0)
            total -= apart * len(dense)
        i = np.repeat(mine[left], len(right))
        j = np.tile(mine[right], len(left))
        fresh = i < j
        return pa.table({"lang": pa.array([lang] * int(fresh.sum()), pa.string()),
                         "i": pa.array(i[fresh].astype(np.int32)),
                         "j": pa.array(j[fresh].astype(np.int32)),
                         "part": pa.array(total.ravel()[fresh])})

    return (rows.groupBy("lang", "slice", "lo", "hi").applyInArrow(add_up, _SUMS_DDL)
            .groupBy("lang", "i", "j").agg(F.sum("part").alias("value")))


def pair_part(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Each group's distance to every other source of its language, all ranks."""
    sums = pair_sums(kept, groups)
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("i").alias("at"), F.col("j").alias("to")),
                                                 F.struct(F.col("j").alias("at"), F.col("i").alias("to"))))
                       .alias("p"), "value").select("lang", "p.*", "value")
    names = groups.select("lang", "source", "at")
    window = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return (both.join(names, ["lang", "at"])
            .join(names.select("lang", F.col("at").alias("to"), F.col("source").alias("item")),
                  ["lang", "to"])
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
            .withColumn("rank", F.row_number().over(window)))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c)
                          for c in ("lang", "source", "text")))
    kept = kept_counts(texts, least_docs)
    groups = store(_groups(texts, kept), "divergence-groups")
    return pair_part(kept, groups).union(term_part(kept, groups, top))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
occ AS (SELECT doc, lang, source,
               unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM occ GROUP BY lang, term
         HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term)
        GROUP BY ALL),
sums AS (SELECT lang, source, sum(c) AS n FROM own GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * l.v) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM grid a JOIN grid b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN distances x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM grid WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value,
       (row_number() OVER (PARTITION BY lang, source, part
                           ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""
