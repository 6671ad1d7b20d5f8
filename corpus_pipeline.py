"""A corpus pipeline: languages, exact copies, near copies, secrets, packing.

Each stage reads what its predecessor wrote and works on all of it; all but the last return the
columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import exact_dedup, jaccard_join, language, packing, secret_scan
from colonnade.llm.common import fresh, read, staged

#: SQL cannot express language models and token ids; the tests hold the stages against brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled ones: texts without letters go, and those that need
    more bits per byte than their closest language's bound. Without labels all with letters stay."""
    row = fresh(docs, "_row")
    model = language.learn(docs)
    found = language.identify(docs, model).where(~F.col("fits"))
    gone = staged(found.select(F.col("row").alias(row)).distinct(), "no_language")
    return docs.withColumn(row, F.xxhash64("doc_id", "text")).join(gone, row, "left_anti").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the one with the smallest id."""
    return exact_dedup.drop_copies(docs).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of at least 0.8 of five-word shingles."""
    return jaccard_join.drop_near_copies(docs, words=5, percent=80).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; `n_chars` follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of at most 1,024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024)


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
