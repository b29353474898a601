"""The corpus pipeline on an awkward table, stage by stage against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from staylens.llm import near_dedup, queries
from staylens.session import scratch_path

BENCH = "which of these planets is known to have the largest number of rings around it"
EN = ["the cat sat on the mat and then it went away to the river for water", "there was a house on "
      "the hill and in it there lived a man with his two old dogs", "we have all been there before, "
      "and it is not what you would think it was"]
DE = ["der hund lief in den wald und kam nicht mehr nach hause zurück", "das haus auf dem berg ist "
      "alt und in ihm wohnt ein mann mit seiner frau", "wir waren alle schon einmal dort und es ist "
      "nicht so wie man denkt"]


@pytest.fixture(scope="module")
def folder(spark):
    rows = []
    for i in range(60):
        words = (EN if i % 2 else DE)[i % 3].split()
        mine = " ".join(w if (j + i) % 7 else f"{w}{'x' * (i % 5)}" for j, w in enumerate(words * 3))
        rows.append((i, f"{mine} {words[i % len(words)]}{chr(97 + i % 26) * 3} {i * 7}", "en" if i % 2 else "de"))
    body = " ".join(f"{w} {EN[0]}" for w in "alpha beta gamma delta epsilon zeta eta theta iota".split())
    rows += [(100, rows[3][1], "en"), (101, rows[3][1], "en"), (102, rows[3][1], None)]       # exact copies
    rows += [(110, body, "en"), (111, body + " omega", "en")]                                 # near copies
    rows += [(120, f"{EN[1]}. {BENCH}. {EN[2]} and so it goes on and on with the old man", "en")]
    rows += [(121, BENCH, "en"), (130, None, "en"), (131, "", "de"), (132, "12 345 !!", "en"),
             (133, None, None), (140, rows[5][1], "en"), (140, rows[5][1], "en"),
             (150, "the house and the river " * 4000 + "are old", "en")]
    docs = spark.createDataFrame([(i, t, lang, f"s{i % 3}", len(t or ""), "extra") for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 "pattern string").repartition(4)
    path = scratch_path(spark, f"pipeline-test-{id(rows)}")
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("q1", BENCH), ("q2", None), ("q3", "")], "item_id string, text string") \
        .write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, held = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, folder)
        assert out.columns == columns
        rows = sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=str)
        seen[name], before = rows, sorted(((r["doc_id"], r["text"] or "") for r in held.collect()), key=str)
        if name == "language_id":
            # without a letter there is no language; clear prose stays
            assert not [t for _, t in rows if not any(c.isalpha() for c in t)]
            assert {i for i, _ in rows} >= {i for i, _ in before if i < 60}
        elif name == "exact_dedup":
            best = {t: max(i for i, u in before if u == t) for _, t in before}
            assert rows == sorted(((i, t) for t, i in best.items()), key=str)
        elif name == "near_dedup":
            shingles = {i: near_dedup_shingles(t) for i, t in before}
            kept = {i for i, _ in rows}
            for i, t in before:
                near = [j for j, _ in before if j != i and similar(shingles[i], shingles[j])]
                assert i in kept or any(j > i for j in near)     # gone only for a later near copy
                assert i not in kept or not [j for j in near if j in kept]
            assert {110, 111} & kept == {111}
        else:
            assert all(BENCH not in t for _, t in rows) and not [i for i, _ in rows if i == 121]
            clean = {i: t for i, t in before if BENCH not in t}
            assert clean.items() <= dict(rows).items() and 120 in dict(rows)
        held = spark.createDataFrame(out.collect(), docs.schema)
    assert set(seen) == {"language_id", "exact_dedup", "near_dedup", "decontaminate"}


def near_dedup_shingles(text):
    words = near_dedup.words(text)
    n = min(5, len(words))
    return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)] if n else []


def similar(a, b):
    """Twice the longest common subsequence of shingles over their union, at 0.8 or more."""
    if not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return False
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        last = row
    return last[-1] / (len(a) + len(b) - last[-1]) >= 0.8


def test_run_returns_tokens_of_what_is_left(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    rows = {r["doc_id"]: r for r in out.collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in
            spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for i in (7, 111):        # clean documents come through whole
        ids = tokenizer.encode(docs[i], add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert not {121, 130, 131, 132, 133, 110, 100, 101} & set(rows)


def test_empty_tables(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
