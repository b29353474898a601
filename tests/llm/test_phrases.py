"""Phrase mining: automata against plain counts, small fixtures by brute force, awkward tables."""

import collections
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staylens.llm import phrases
from staylens.llm.count_transducer import CountTransducer

TEXTS = st.lists(st.text(alphabet="aAbé. \t\n\x0b\x1c\xa0", max_size=60), max_size=8)


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
        yield re.findall("[^ \t]+", piece)


def grams(texts):
    out = collections.Counter()
    for text in texts:
        for words in pieces(text):
            for n in (1, 2, 3):
                out.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return out


def counts(auto):
    return dict(zip((tuple(s.split(" ")) for s in auto.sequences()), auto.counts.tolist()))


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9), st.integers(1, 9))
def test_shards_count_like_brute_force(texts, tokens, chars):
    saved = phrases.SHARD_TOKENS, phrases.BLOCK_CHARS
    phrases.SHARD_TOKENS, phrases.BLOCK_CHARS = tokens, chars
    try:
        autos = [CountTransducer.loads(a.dumps())
                 for _, a in phrases.shard_automata(("x", t) for t in texts)]
    finally:
        phrases.SHARD_TOKENS, phrases.BLOCK_CHARS = saved
    got = counts(CountTransducer.union(autos)) if autos else {}
    assert got == grams(texts)


def test_automaton_composes_cuts_and_shares_states():
    texts = [" ".join(np.random.default_rng(i).choice(list("abcde"), 30)) for i in range(6)]
    (_, auto), = phrases.shard_automata(("x", t) for t in texts)
    want = grams(texts)
    assert counts(auto) == want
    rising = sorted(want)
    for bound in [("a", "", ""), ("b", "bb", ""), ("c", "a", "d"), ("", "", ""), ("z", "", "")]:
        key = tuple(w for w in bound if w)
        assert auto.cut(bound) == sum(g < key for g in rising)
    asked = CountTransducer.union(a for _, a in phrases.shard_automata([("x", "a b q. c d e")]))
    assert counts(auto.compose(asked)) == {g: want[g] for g in grams(["a b q. c d e"]) if g in want}
    state, sizes, first = auto._states(np.array([1, 0, 2, 1]), np.array([7, 3, 4, 7]),
                                       np.array([1, 1, 1, 1]))
    assert state.tolist() == [1, 0, 2, 1] and sizes.tolist() == [1, 2] and first.tolist() == [0, 1]


def brute(rows, least, share, top):
    by = collections.defaultdict(list)
    for text, lang in rows:
        by[lang if lang is not None else "und"].append(text or "")
    out = []
    for lang, texts in by.items():
        f = grams(texts)
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            if any(len(h) > len(g) and 100 * c >= share * a and c >= least
                   and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
                   for h, c in f.items() if len(h) <= 3):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def test_phrases_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(["a", "B", "é", "d.", "cc"], int(rng.integers(0, 40)))), lang)
            for lang in ("en", None, "", "fr") for _ in range(40)]
    rows += [(None, "en"), ("", "de"), ("x" * 50_000 + " y", "de"), (rows[0])] + [("a b c", "en")] * 30
    docs = spark.createDataFrame([(None, t, lang, "w", 5) for t, lang in rows],
                                 "doc_id long, text string, lang string, word string, n int")
    for least, share, top in ((3, 50, 2000), (2, 80, 7), (10, 50, 3)):
        got = phrases.mine_phrases(docs, least, share, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, share, top)
    assert phrases.mine_phrases(docs.limit(0)).count() == 0
    assert phrases.mine_phrases(docs.select("doc_id", F.lit(None).cast("string").alias("text"),
                                            "lang")).count() == 0


def test_scores_are_exact_beyond_64_bits():
    big = 3_000_000_000_000
    auto = CountTransducer(["a", "b"], np.array([1 << 42, 1 << 42 | 2 << 21, 2 << 42], np.uint64),
                           np.array([big + 1, big, big + 7]))
    (_, (score, left, right)), = phrases._weigh(auto, auto).items()
    assert (score, left, right) == (10**6 * big * big // ((big + 1) * (big + 7)), big + 1, big + 7)
