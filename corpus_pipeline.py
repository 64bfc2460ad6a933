"""The corpus pipeline: quality, near-duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veridicta.llm.common import checkpoint_folder, exists, remove, table
from veridicta.llm.compression import keep_good
from veridicta.llm.entropy_mix import take
from veridicta.llm.packing import TOKENIZER, pack_documents
from veridicta.llm.prefix_free import dedup_bytes
from veridicta.llm.prob_minhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of 400 bytes or more that occur elsewhere are cut out of the texts; all documents stay."""
    return dedup_bytes(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return take(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]

ORACLE_SQL = None  # compression, signatures and tokens are not SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``.  With a ``folder`` the stages stay there, and a run that was stopped goes on behind
    the last one it finished; without one each goes as soon as the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    own = folder is None
    folder = folder or f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if own and before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
