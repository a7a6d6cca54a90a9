"""Queries of this folder's operators over whole tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fossick.llm import chat, embeddings, lines, mixing, pieces, quality, secrets, simhash, substrings, token_counts
from fossick.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
SENTENCE_PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keep_good(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_chars")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "documents")).drop("row")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), SENTENCE_PIECES)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"), BYTE_BPE)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_substring_dedup, op4_secret_scans, op5_embedding_dedup, op6_source_mixing, op7_line_dedup, op8_sentencepiece, op9_chat_formatting, op10_simhash)}

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality.keep_sql(), "op6_source_mixing": mixing.schedule_sql()}
