"""Registered queries of the operators that map texts in Python tasks (1, 3, 8, 13)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.llm import alignment, bpe, language, secrets

#: Vocabulary files, parameters of the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS_PATTERN = public_tokenizers.PATTERN
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = language.learn_languages(docs.where(~language.held_out()))
    found = language.identify_languages(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORD_BPE, keep=())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE_RANKS, RANKS_PATTERN)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    based = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(n, secrets.BASE), F.sha2(secrets.spans_text(based), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE_BPE, PIECE_BPE)


QUERIES = {f.__name__: f for f in (op1_language_id, op3_bpe, op8_secret_scan, op13_cross_tokenizer_alignment)}
ORACLES: dict[str, str] = {}
