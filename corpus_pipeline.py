"""The corpus pipeline: documents in, clean tokenised documents out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``.

Defined cases: documents without a letter (null and empty ones too) or without a main
language go in the first stage; of equal texts the row with the largest id stays, of rows
repeated in id and text one; a document made mostly of benchmark passages goes, others
lose them; null ids are kept and told apart by text; empty tables give empty
results; other columns pass through all stages but the last, which returns
``doc_id``, ``n_tokens``, ``ids``, ``ids_sha256`` and ``decoded_sha256``.
"""

from __future__ import annotations

import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

from staylens.llm import bpe_tables, decontaminate, exact_dedup, language, near_dedup  # noqa: E402
from staylens.llm.common import store, table  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or without a main one, go."""
    return language.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, one document stays."""
    return near_dedup.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents made mostly of them go."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded text."""
    return bpe_tables.round_trip(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("bpe", token_stage),
]

#: The pipeline holds learned and iterative stages that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is stored and reread."""
    docs = table(spark, sf_dir, "documents")
    *firsts, last = STAGES
    docs = reduce(lambda d, s: store(s[1](spark, d, sf_dir), f"pipeline-{s[0]}"), firsts, docs)
    return last[1](spark, docs, sf_dir)
