"""Training-text pipeline: each stage is written as Parquet and read again as the next stage's documents.

Decisions are carried back to rows by doc_id and text (and language and source where they count), null-safe,
so rows without a doc_id, and different texts under one doc_id, are each judged for themselves. Every stage
takes null and empty texts of any length, ties, repeated rows, empty tables and extra columns, which stay.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import round_trip
from millrace.llm.hyperminhash import near_duplicates
from millrace.llm.robust_outliers import quality_rules
from millrace.llm.secret_forest import scan
from millrace.llm.storage import through_table
from millrace.llm.template_windows import contaminated


def _semi(docs: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of docs whose text_hash and other keys, null or not, occur in `rows`."""
    rows = rows.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same: list[Column] = [(F.xxhash64(docs["text"].cast("string")) if k == "text_hash" else docs[k]).eqNullSafe(rows[f"__{k}"]) for k in keys]
    return docs.join(rows, reduce(lambda a, b: a & b, same), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source.

    Null or empty texts have no words and go; rows with a null doc_id, language or source are judged like any
    other; repeated rows share their verdict; an empty table gives an empty one.
    """
    return _semi(docs, quality_rules(docs).where("kept"), "doc_id", "text_hash", "lang", "source")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates.

    Null or empty texts belong to no group and stay. Rows with a null doc_id go where their group has a
    document with one, and stay otherwise; rows that repeat the doc_id and text of the one kept stay with it.
    """
    return _semi(docs, near_duplicates(docs).where("kept"), "doc_id", "text_hash")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item and no re-parameterised one.

    A text decides for all its rows, whatever their doc_id; null and empty texts stay, and so does everything
    where the benchmark is empty.
    """
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("text_hash").alias("__t")).distinct()
    return docs.join(found, F.xxhash64(docs["text"].cast("string")) == F.col("__t"), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the new text, null for a null text."""
    new = {c: F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns}
    return scan(docs).select(*new.values())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text counts as empty."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", deduplicate), ("decontaminate", decontaminate), ("secrets", redact_secrets), ("byte_bpe", tokenize)]

#: The forest, the outlier distances and the merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
