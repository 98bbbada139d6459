"""A corpus pipeline of five stages: from documents to token ids in training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.llm import bpe, language, minhash, mixing, secrets
from weblake.llm.queries_models import BYTE_RANKS, RANKS_PATTERN, WORD_BPE
from weblake.llm.storage import CONTENT, ROW, numbered, stored

#: A text is rejected if fewer of its n-grams than this belong to any known language.
LEAST_SCORE = 0.15


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that hardly resemble any language of the corpus."""
    filters = language.learn_languages(docs)
    names = ("weblake language", "weblake score")
    rest = tuple(c for c in docs.columns if c != "doc_id")
    judged = language.identify_languages(docs, filters, keep=rest, names=names)
    return judged.where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one of smallest id.

    Of rows of one id, the one whose values have the least hash stands for all; a row without id is
    a document of its own, and gives way to those with one.
    """
    rows = numbered(docs)
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(CONTENT, ROW)).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = stored(rows.join(first, "doc_id").where(F.col(ROW) != F.col("first")[ROW]).select(ROW))
    if not repeats.isEmpty():
        rows = stored(rows.join(repeats, ROW, "left_anti"))
    place = F.struct(F.isnull("doc_id").alias("without"), "doc_id", CONTENT, ROW)
    classes = minhash.near_duplicates(rows.select(ROW, "text"), id_col=ROW).join(rows.select(ROW, place.alias("place")), ROW)
    kept = classes.groupBy("class_id").agg(F.min("place")[ROW].alias(ROW)).select(ROW)
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; all documents stay."""
    masked = secrets.mask_secrets(docs, BYTE_RANKS, RANKS_PATTERN)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def in_mix_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sorts all documents into a mix of their sources; the files hold them in this order."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes all documents: doc_id, position and offset in the mix, n_tokens, ids_sha256, decoded_sha256, ids.

    A reader of files packs them by size, so their order does not last: each row is given its place,
    worked out again on the same documents, and the training order is that of position and offset.
    """
    rows = mixing.placed(docs).select("doc_id", "text", F.col("mix position").alias("position"), F.col("mix offset").alias("offset"))
    return bpe.encode(rows, WORD_BPE, keep=("ids",), carry=("position", "offset"))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("secret_scan", without_secrets),
    ("source_mix", in_mix_order),
    ("bpe", token_ids),
]

#: Several stages have no SQL form: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
