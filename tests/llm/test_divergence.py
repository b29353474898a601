"""Source divergence: packed counts against plain counts, small fixtures by brute force,
awkward tables."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staylens.llm import divergence, packed_terms
from staylens.llm.packed_terms import TermCounts

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aBé日😀z -0", max_size=40), st.integers(0, 2)),
                max_size=12), st.integers(0, 3))
def test_packed_counts_equal_plain_counts(rows, skip):
    texts = pa.array([t for t, _ in rows], pa.string()).slice(min(skip, len(rows)))
    rows = rows[min(skip, len(rows)):]
    group = np.array([g for _, g in rows], dtype=np.uint64)
    count, docs = collections.Counter(), collections.Counter()
    for text, g in rows:
        count.update((t, g) for t in terms(text))
        docs.update({(t, g) for t in terms(text)})
    got = {}
    for kind, of, words, doc in packed_terms.occurrences(texts, 0, group):
        names = None
        if kind == packed_terms.LONG:
            names = sorted(set(words))
            words = [np.array([names.index(w) for w in words], dtype=np.uint64)]
        counted = TermCounts.runs(of, words, doc, names)
        if not len(counted.group):
            continue
        half = np.arange(len(counted.group)) % 2 == 0
        parts = [TermCounts.unpacked(counted.take(np.flatnonzero(h)).packed(), kind)
                 for h in (half, ~half) if h.any()]
        whole = TermCounts.merged(parts)
        for t, g, c, d in zip(whole.terms(np.arange(len(whole.group))), whole.group.tolist(),
                              whole.count.tolist(), whole.docs.tolist()):
            size = len(t.encode())
            assert kind == (size > 8) + (size > 16)
            got[t, g] = c, d
    assert got == {k: (count[k], docs[k]) for k in count}


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 3, 500).astype(np.uint64),
            rng.integers(0, 2**64 - 1, 500, dtype=np.uint64, endpoint=True)]
    keys[1][::7] = keys[1][3]
    assert packed_terms.radix_order(keys).tolist() == sorted(
        range(500), key=lambda i: (int(keys[0][i]), int(keys[1][i])))


def brute(rows, least, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    df, total, own = collections.Counter(), collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        found = terms(text)
        df.update((lang, t) for t in set(found))
        for t in found:
            total[lang, t] += 1
            own[lang, source, t] += 1
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        sources = sorted({s for x, s, _ in rows if x == lang})

        def shares(count):
            n = sum(map(count, kept))
            return {t: 1 + (10**9 * (count(t) + 5)) // (n + 5 * len(kept)) for t in kept}

        whole = shares(lambda t: total[lang, t])
        mine = {s: shares(lambda t, s=s: own[lang, s, t]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(mine[s][t] - mine[o][t]) for t in kept), o) for o in sources if o != s]
            high = [(whole[t] - mine[s][t], t) for t in kept
                    if own[lang, s, t] and mine[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs, key=lambda p: (p[0], p[1].encode()))),
                                ("term", sorted(high, key=lambda p: (p[0], p[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    vocabulary = ["a", "Be", "été", "straße", "exactly8", "ninechars", "sixteenlettersxx",
                  "seventeenlettersx", "日本語日本語日本語", "a1b", "x" * 40]
    out = []
    for i in range(150):
        lang = ["en", None, "de", ""][i % 4]
        chosen = rng.choice(vocabulary, int(rng.integers(0, 30)))
        out.append((lang, f"s{int(rng.integers(0, 5)) if i % 3 else 0}", " ".join(chosen)))
    out += [("en", None, None), ("en", "only empty", ""), ("fr", "a", "one"), ("fr", "b", None),
            ("en", "long", "word " * 20_000), out[4], out[4], ("xx", "alone", "a")]
    return out


def test_divergence_against_brute_force(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(None, l, s, t, "term", 1, 2) for l, s, t in rows],
                                 "doc_id long, lang string, source string, text string, "
                                 "term string, at int, value int").repartition(5)
    for least, top, block, slice_ in ((3, 50, 64, 4096), (3, 2, 2, 3), (1, 5, 1, 1), (10**6, 5, 3, 9)):
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "SLICE", slice_)
        got = divergence.audit_sources(docs, least, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)
    assert divergence.audit_sources(docs.limit(0)).count() == 0
    empty = docs.withColumn("text", F.lit(None).cast("string"))
    got = divergence.audit_sources(empty)
    assert sorted(tuple(r) for r in got.collect()) == brute(
        [(lang, s, None) for lang, s, _ in rows], 30, 50)
