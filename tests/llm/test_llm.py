"""Training-data operators: fixed cases, brute force, and awkward tables."""

import collections
import hashlib
import itertools
import math
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from staylens.llm import (bpe_tables, components, decontaminate, exact_dedup, html_text, katz,
                          language, near_dedup, shards, token_files, toxicity)
from staylens.llm.bpe import word_bpe
from staylens.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, class int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", " ", "Hello  world's\n\n 12 ab", "naïve 日本語 ĀԱ՘ 😀 <|endoftext|> x", "!!! ***",
         "one two three four five six seven", "one two three four five six seven", LONG, LONG]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "r", 1)
            for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "no id", "en", "s", 5, None, None), (None, None, None, None, None,
                                                                   None, None)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def both(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n'sa1!é՘日<|endoftext|>"),
                                  st.characters(codec="utf-8")), max_size=40))
def test_words_encode_like_the_library(text):
    bpe = word_bpe(PATH)
    assert bpe.ids(text) == bpe.tokenizer.encode(text, add_special_tokens=False).ids
    assert "".join(bpe.split(text)) == text


def test_ids_equal_the_library(tokenizer):
    bpe = word_bpe(PATH)
    for text in [t or "" for t in TEXTS] + ["a  <|endoftext|>  b", "\t\n x", "'s't <|endoftext|>"]:
        assert bpe.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs, empty, tokenizer):
    path = scratch_path(spark, f"test-token-files-{uuid.uuid4().hex}")
    token_files.write_token_files(docs, path + "-a", PATH, segment_ids=50)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
                 for r in token_files.read_token_files(spark, path + "-a").collect())
    want = collections.Counter()
    for i, t in both(docs):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((i, n, c) for _, i, n, c in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [i for _, i, _, _ in got if i is not None]
    assert ids == sorted(ids)
    one = token_files.document_ids(spark, path + "-a", docs.filter("doc_id = 3")).first()
    assert one["ids"][:-1] == tokenizer.encode(TEXTS[3], add_special_tokens=False).ids
    token_files.write_token_files(empty, path + "-b", PATH)
    assert token_files.read_token_files(spark, path + "-b").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=700))
def test_elias_fano(values):
    values = np.sort(np.array(values))
    code = token_files.EliasFano.encode(values)
    assert code.values().tolist() == values.tolist()
    assert [code.select(i) for i in range(len(values))] == values.tolist()


def test_shards(spark, docs, empty):
    rows = shards.shard_documents(docs).collect()
    assert len(rows) == len(both(docs))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(r["size"] for r in rows) == sorted(len(t.encode()) + 8 for _, t in both(docs))
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sizes = [r["count"] for r in shards.shard_documents(ids, (1.0, 1.0, 2.0)).groupBy("shard")
             .count().orderBy("shard").collect()]
    assert abs(sizes[2] - 10_000) < 500 and abs(sizes[0] - 5_000) < 400
    assert shards.shard_documents(empty).count() == 0


def test_round_trip(docs, empty, tokenizer):
    got = collections.Counter(tuple(r) for r in bpe_tables.round_trip(docs, PATH).collect())
    want = collections.Counter()
    for i, t in both(docs):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(back.encode()).hexdigest()] += 1
    assert got == want
    assert bpe_tables.round_trip(empty, PATH).count() == 0


def test_exact(docs, empty):
    rows = exact_dedup.exact_dedup(docs).collect()
    groups = collections.defaultdict(list)
    for i, t in both(docs):
        groups[t].append(i)
    assert len(rows) == len(both(docs)) and sum(r["kept"] for r in rows) == len(groups)
    for r in rows:
        same = [g for t, g in groups.items()
                if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]][0]
        assert r["group_size"] == len(same)
        assert r["keep_id"] == max((i for i in same if i is not None), default=None)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(t for _, t in both(kept)) == sorted(groups)
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_exact_with_heavy_hitters(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(rows)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 and keep_id = 2997").count() == 1000


def test_near_closing_pass(spark, monkeypatch):
    """A group whose pairs lie around 0.8: all links with an equal sketch are found,
    in blocks of a few members too."""
    import random
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(120):
        seq = list(base)
        for at in rnd.sample(range(200), rnd.choice([2, 3, 4, 5])):
            seq[at] = f"x{i}_{at}"
        texts[i] = " ".join(seq)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()}
    shingler = near_dedup.Shingler()
    bodies = {i: shingler(decontaminate.words(t)).astype("<u4") for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    rows = {i: [(i, len(b), i, near_dedup.parity_print(b))] for i, b in bodies.items()}
    links = 0
    for i in texts:
        for j in range(i):
            if near_dedup.alignment_similarity(bodies[i], bodies[j]):
                links += 1
                assert list(near_dedup.unexcluded_pairs(rows[j], rows[i], 0.8)) == [(j, i)]
                root[find(j)] = find(i)
    want = {i: max(j for j in texts if find(j) == find(i)) for i in texts}
    assert got == want and 0 < links < 120 * 119 / 2


def test_alignment_equals_a_plain_one():
    """Without a band; text in front that makes the similarity exactly 0.8 included."""
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
        found = row[-1] / (len(a) + len(b) - row[-1])
        return found if found >= 0.8 else 0.0

    for k in range(1, 30):
        a = np.arange(5 * k, dtype="<u4")
        for b in (a[k:], a[:-k], a[k // 2:len(a) - (k - k // 2)]):
            assert near_dedup.alignment_similarity(a, b) == plain(a, b) == 0.8
            assert near_dedup.alignment_similarity(b, a) == 0.8
    rng = np.random.default_rng(8)
    for _ in range(200):
        a = rng.permutation(60)[:int(rng.integers(1, 40))].astype("<u4")
        b = np.delete(a, rng.integers(0, len(a), int(rng.integers(0, 1 + len(a) // 4))))
        at = int(rng.integers(0, len(b) + 1))
        b = np.insert(b, at, rng.permutation(np.arange(100, 110))[:int(rng.integers(0, 5))])
        assert near_dedup.alignment_similarity(a, b.astype("<u4")) == plain(a, b)


def test_near(spark, docs, empty):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abcdefghijklmnop"), 4)) for _ in range(100)]
    base = " ".join(base).split()
    near = base.copy()
    near[50] = "changed"
    far = base[:200] + ["other%d" % i for i in range(200)]
    table = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)),
                                   (4, " ".join(base).upper())], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()}
    assert got == {1: 4, 2: 4, 4: 4, 3: 3}
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(t for _, t in both(kept)) == sorted({t for _, t in both(docs)})
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [
        (100, 101), (101, 100), (100, 101), (7, 7), (500, None), (None, 501), (None, None)],
                                  "u long, v long")
    got = {r["node"]: r["class"] for r in components.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_hits(text, items, window=10):
    seq = decontaminate.words(text)
    hit, found = set(), set()
    for item, raw in items:
        w = decontaminate.words(raw)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(seq) - n + 1):
                if seq[j:j + n] == w[i:i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return hit, found


def test_decontaminate(spark, docs, empty):
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(rng.choice(list("abc"), n))
    items = [(i, draw(int(rng.integers(0, 16)))) for i in range(12)] + [(3, "a b"), (50, None)]
    texts = [(i, draw(int(rng.integers(0, 60)))) for i in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (600_000, 60):
        for r in decontaminate.contamination(table, bench, chunk_bytes=chunk).collect():
            hit, found = brute_hits(dict(texts)[r["doc_id"]], [(str(i), t) for i, t in items])
            assert (r["n_hit"], r["n_items"]) == (len(hit), len(found))
            assert r["items_sha256"] == hashlib.sha256(
                ",".join(sorted(found)).encode()).hexdigest()
    cut = decontaminate.remove_contamination(table, bench)
    assert decontaminate.contamination(cut, bench).filter("contaminated").count() == 0
    assert decontaminate.remove_contamination(docs, bench).columns == docs.columns
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_cuts_are_the_same_for_any_chunk_size(spark):
    rng = np.random.default_rng(4)
    draw = lambda n: " ".join(rng.choice(list("abc"), n))
    items = [(i, draw(int(rng.integers(3, 16)))) for i in range(12)]
    rows = [(i, draw(int(rng.integers(0, 30))) + " . " + " ".join(
        f"x{i}_{k}" for k in range(int(rng.integers(0, 90))))) for i in range(60)]
    # two items of 30 words each in a text of 100; two items that overlap in a text
    halves = [" ".join(f"{c}{k}" for k in range(30)) for c in "pq"]
    line = [f"r{k}" for k in range(27)]
    items += [(100, halves[0]), (101, halves[1]), (102, " ".join(line[:20])),
              (103, " ".join(line[15:]))]
    fill = [" ".join(f"{c}{k}" for k in range(40)) for c in "st"]
    rows += [(1000, f"{halves[0]} {fill[0]} {halves[1]}"),
             (1001, f"{fill[0]} {' '.join(line)} {fill[1]}"), (1002, None),
             (None, f"{fill[0]} {halves[0]}"), (1003, f"{fill[0]} {halves[0]}"),
             (1003, f"{fill[0]} {halves[0]}")]
    table = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows],
                                  "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "")
    one, many = (sorted(decontaminate.remove_contamination(table, bench, chunk_bytes=b)
                        .collect(), key=lambda r: str(key(r))) for b in (600_000, 60))
    assert one == many and 0 < len(one) < len(rows)
    texts = {r["doc_id"]: r["text"] for r in many}
    assert 1000 not in texts and texts[1001].split() == (fill[0] + " " + fill[1]).split()
    assert all(r["n_chars"] == len(r["text"] or "") for r in many)


def test_language(spark, docs, empty):
    en, de = "the cat and the dog were there", "der hund und die katze waren dort"
    table = spark.createDataFrame(
        [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(60)]
        + [(100, (en + " ") * 5 + (de + " ") * 9, None), (101, None, "en"), (102, "12 !", "en")],
        "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict_languages(table).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert got[100]["lang_pred"] == "de" and got[100]["n_spans"] == 2
    assert got[101]["lang_pred"] == got[102]["lang_pred"] == "und"
    assert language.keep_identified(docs).columns == docs.columns
    assert language.predict_languages(empty).count() == 0


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(40):
        s = rng.normal(size=(6, 2)) * 3
        path = language.viterbi(s, 2.0)

        def value(p):
            return sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(
                a != b for a, b in zip(p, p[1:]))

        best = max(value([(k >> i) & 1 for i in range(6)]) for k in range(64))
        assert math.isclose(value(path), best)


def test_viterbi_of_several_languages():
    """Two languages may win together over a third that is the best alone."""
    def value(s, p):
        return sum(s[i, x] for i, x in enumerate(p)) - 12.0 * sum(
            a != b for a, b in zip(p, p[1:]))

    halves = np.array([[0.0, -25, -10], [-25, 0, -10]])
    assert language.viterbi(halves, 12.0) == [0, 1]
    rng = np.random.default_rng(6)
    for _ in range(600):
        n, k = int(rng.integers(1, 6)), int(rng.integers(3, 5))
        s = rng.normal(size=(n, k)) * rng.choice([4, 8, 16])
        best = max(value(s, p) for p in itertools.product(range(k), repeat=n))
        assert math.isclose(value(s, language.viterbi(s, 12.0)), best, abs_tol=1e-9)


def test_toxicity(spark, docs, empty):
    rows = [(i, ("you idiot scum " if i % 4 == 0 else "kind words ") + f"more text n{i % 50}")
            for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None)],
                                   "doc_id long, toxic int")
    got = toxicity.score_toxicity(table, labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == len(both(docs))
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_toxicity_learns_words_from_all_labelled_rows(spark, monkeypatch):
    rows = [(i, ("you idiot scum " if i % 4 == 0 else "kind words ") + f"more text n{i % 50}")
            for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)],
                                   "doc_id long, toxic int")
    whole = toxicity.train(table, labels)[0]
    monkeypatch.setattr(toxicity.sample_labels, "__defaults__", (20,))
    assert toxicity.train(table, labels)[0] == whole and "w:idiot" in whole


def test_toxicity_without_labels_of_both_kinds_in_both_folds(spark, docs):
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    table = spark.createDataFrame(
        [(i, ("you idiot scum " if i % 4 == 0 else "kind words ") + f"n{i % 9}", "x", 1)
         for i in range(400)] + [(3, None, None, None), (3, "", "y", 0), (None, "kind", "z", 0)],
        "doc_id long, text string, pattern string, y int")
    for mine in ([i for i in range(400) if fold(i) == 0], [i for i in range(400) if fold(i) == 1],
                 [i for i in range(400) if fold(i) == 0 or i % 4 == 0], []):
        labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in mine], "doc_id long, toxic int")
        used = [i for i in mine if fold(i) != 2]
        want = sum(i % 4 == 0 for i in used) / len(used) if used else 0.0
        got = toxicity.score_toxicity(table, labels).collect()
        assert len(got) == 403 and all(abs(r["score"] - want) < 1e-5 for r in got)
    # labels of documents that are not there teach nothing; repeated and empty texts score alike
    labels = spark.createDataFrame([(i + 10_000, int(i % 4 == 0)) for i in range(400)],
                                   "doc_id long, toxic int")
    assert len({round(r["score"], 9) for r in toxicity.score_toxicity(table, labels).collect()}) == 1
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(table, labels).collect()
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got)
    empties = {r["score"] for r in got if r["doc_id"] == 3 and r["score"] != next(
        x["score"] for x in got if x["doc_id"] == 7)}
    assert len(empties) == 1
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert scores[0] == scores[1] and scores[6] == scores[7] and scores[8] == scores[9]


def test_label_model_counts_correlated_voters_once():
    votes = np.array([[2, 2, 1], [1, 1, 2], [1, 1, 1]])
    model = toxicity.LabelModel().fit(votes, np.array([50.0, 50.0, 400.0]),
                                      np.array([[10, 10], [2, 18], [80, 5.0]]))
    p = model.posterior(votes)
    assert p[1] > p[0] > p[2]


def test_katz_against_brute_force(spark, docs, empty):
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 30))))) for i in range(80)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    c1, succ = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = katz.tokens(t)
            c1.update(w)
            for a, b in zip([b" ", *w], w):
                succ[a][b] += 1
    hist = lambda c: np.array([sum(x == r for x in c) for r in range(1, 7)])
    d1 = katz.Level(katz.good_turing(hist(c1.values())))
    d2 = katz.Level(katz.good_turing(hist([n for s in succ.values() for n in s.values()])))
    total = sum(c1.values())
    uni = katz.Unigrams(d1, total, len(c1), 0, tuple(hist(c1.values()).tolist()), None, 0)
    p1 = lambda w: float(uni.probability(np.array([c1[w]]))[0])

    def p2(a, b):
        s = succ[a]
        n = sum(s.values())
        if not n:
            return p1(b)
        plain = all(c > katz.K for c in s.values())
        keep = n / (n + len(s)) if plain else 1.0
        mass = keep * sum(float(d2.discounted(np.array([c]))[0]) for c in s.values()) / n
        if b in s:
            return keep * float(d2.discounted(np.array([s[b]]))[0]) / n
        return (1 - mass) / (1 - sum(map(p1, s))) * p1(b)

    for options in ({}, {"hot_least": 20, "bucket_tokens": 100}):
        for r in katz.score_documents(table, **options).collect():
            w = katz.tokens(dict(texts)[r["doc_id"]])
            assert math.isclose(r["score"], sum(math.log10(p2(a, b)) for a, b in
                                                zip([b" ", *w], w)), rel_tol=1e-9, abs_tol=1e-9)
    assert katz.score_documents(docs).count() == len(both(docs))
    assert katz.score_documents(empty).count() == 0


def test_hot_histories_meet_before_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [("hot", b, h, None, None, rng.random(1).tobytes(), b + 1, [h, b, 1, 2, 3])
            for h in range(3) for b in range(50)]
    pairs = spark.createDataFrame(rows, katz._TABLE_DDL).repartition(5)
    kind, sizes = type(pairs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: sizes.append(len(r := collect(df))) or r)
    got = katz._hot_histories(pairs)
    assert sizes == [3] and sorted(got) == [0, 1, 2]
    for h, (n, small, mass) in got.items():
        assert (n, list(small)) == (1275, [50 * h, 1225, 50, 100, 150])
        assert mass == sum(float(np.frombuffer(r[5])[0]) for r in rows if r[2] == h)


def test_html(spark):
    page = ("<title>t</title>a <b>b</b>c<p>one<p>two<br>three<ul><li>x<li>y<ul><li>z</ul></ul>"
            "<table><tr><td>k<td>v<tr><td>longer<td>w</table><div hidden>no</div>"
            "<pre> p\n  q</pre>1 < 2 &amp; 3</i>")
    assert html_text.page_text(page) == (
        "a bc\n\none\n\ntwo\nthree\n\n- x\n- y\n  - z\n\nk       v\nlonger  w\n\n p\n  q\n\n1 < 2 & 3")
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<div>" * 5000 + "deep"),
                                  (3, "u", "x")], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html_text.extract_text(rows).collect()]
    assert sorted(got) == [(1, ""), (2, ""), (3, "deep"), (3, "x")]
    assert html_text.extract_text(rows.limit(0)).count() == 0


def test_html_shows_what_a_browser_shows():
    text = html_text.page_text
    assert text("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac>"
                "<annotation>tex</annotation></math> b") == "a x= 1 2 b"
    assert text("<svg>no<title>no</title><defs><text>no</text></defs><path d='m'/><style>no</style>"
                "<g><text x=1>one <tspan>1</tspan></text><text/><text>two</text></g></svg>end"
                ) == "one 1\ntwo\nend"
    assert text("<svg><g><p>after an open drawing") == "after an open drawing"
    assert text("a<textarea>\nx  &lt;b>\n y</textarea>b") == "a\nx  <b>\n y\nb"
    options = "<option>one<option>two &amp; 2<optgroup label=g><option{}>three</select>b"
    assert text("a<select>" + options.format("")) == "a one b"
    assert text("a<select>" + options.format(" selected")) == "a three b"
    assert text("a<select multiple>" + options.format("")) == "a\none\ntwo & 2\ng\nthree\nb"
    assert text("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no"
                "<i>no</i></div><ol><li style='visibility:hidden'>no<li>z</ol>") == "yes\n\n2. z"
    assert text("<div style='display:none'>no<b style='visibility:visible'>no</b></div>") == ""
    assert text("<ul type=hidden><li>x</ul><input type=hidden>") == "- x"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-2**63, 2**63 - 1), max_size=20), st.integers(0, 3))
def test_segment_ids_round_trip(ids, nulls):
    head, code = token_files._id_code([None] * nulls + sorted(ids))
    assert token_files._ids_of(*head, *code.parts()) == [None] * nulls + sorted(ids)
