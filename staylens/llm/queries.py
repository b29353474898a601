"""Registered queries of the training-data operators: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from staylens.llm import (bpe_tables, decontaminate, divergence, exact_dedup, html_text, katz, language,
                          near_dedup, personal, phrases, shards, token_files, toxicity)
from staylens.llm.common import table
from staylens.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"llm-token-files-{uuid.uuid4().hex}")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.read_token_files(spark, path)


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op3_bpe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tables.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "labels"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.span_digests(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_rendezvous_shards": op2_rendezvous_shards,
    "op3_bpe_tables": op3_bpe_tables,
    "op4_toxicity": op4_toxicity,
    "op5_katz": op5_katz,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_html_text": op10_html_text,
    "op11_personal_data": op11_personal_data,
    "op12_phrases": op12_phrases,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op12_phrases": phrases.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
