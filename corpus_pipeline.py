"""Corpus pipeline: classify, deduplicate, redact, mix and pack the documents.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again as the next one's docs. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.llm import copies, mixing, packing, quality, secrets
from postlode.llm.common import materialise, rows_of


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    trees = quality.learn(docs, rows_of(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return quality.accepted(docs, trees)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("near-dedup", keep_one_of_near_copies),
    ("secret scan", redact_secrets),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trees, fingerprints by XXH64 and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = rows_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
