"""Registered queries over whole tables against what can be recomputed without the library:
shards, token counts and base scores, folds, held-out accuracy."""

import collections
import math
import re
import struct
import zlib

import pytest
import xxhash

from staylens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_op2_shards(spark, documents):
    def winner(doc_id, n):
        best = None
        for shard in range(n):
            seed = xxhash.xxh64_intdigest(str(doc_id).encode(), 42)
            bits = xxhash.xxh64_intdigest(f"shard-{shard}".encode(), seed) >> 12
            score = 1.0 / -math.log((bits + 0.5) / (1 << 52))
            if best is None or score > best[0]:
                best = score, shard
        return best[1]

    slots = collections.defaultdict(list)
    rows = QUERIES["op2_rendezvous_shards"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        raw = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (winner(r["doc_id"], 24), winner(r["doc_id"], 25))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5_counts_and_base_scores(spark, documents):
    tokens = {}
    for i, r in documents.items():
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (r["text"] or "").encode())
        tokens[i] = [*WORD.findall(low), None]
    counts = collections.Counter()
    for i, words in tokens.items():
        if remainder(i, 7) != 2:
            counts.update(words)
    n, v = counts.total(), len(counts)
    rows = QUERIES["op5_katz"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        words = tokens[r["doc_id"]]
        base = math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert r["held_out"] == (remainder(r["doc_id"], 7) == 2)
        assert (r["n_tokens"], r["train_tokens"]) == (len(words), n)
        assert r["n_known"] == sum(w in counts for w in words)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0


def test_op4_folds_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op4_toxicity"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (remainder(i, 4) == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in labels if i in rows and rows[i]["held_out"] and labels[i] is not None]
    right = sum(rows[i]["predicted"] == labels[i] for i in held)
    assert len(held) > 50 and right >= 0.9 * len(held)


def test_op9_folds_and_held_out_accuracy(spark, documents):
    rows = QUERIES["op9_language_id"](spark, SF).collect()
    assert len(rows) == len(documents)
    known = {r["lang"] for r in documents.values()} | {"und"}
    right = held = 0
    for r in rows:
        doc = documents[r["doc_id"]]
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0)
        assert r["lang_pred"] in known and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in doc["text"] or ""))
        if r["held_out"] and doc["lang"] and r["lang_pred"] != "und":
            held += 1
            right += r["lang_pred"] == doc["lang"]
    assert held > 20 and right >= 0.95 * held
