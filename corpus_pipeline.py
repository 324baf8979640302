"""A corpus pipeline of five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from filigree.llm import mixing, packing, quality, sketches, substrings
from filigree.llm.shared import shared_dir


#: Likeness of shingle sets from which minhash_dedup links documents.
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the compression bands go."""
    return quality.quality_filter(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group stays; groups link at PERCENT, op7's contract at its own 85.

    Rows of one id stay or go together; a row without an id is in no group and stays.
    """
    found = sketches.near_duplicates(docs.select("doc_id", "text"), PERCENT)
    kept = docs.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows are cut; documents left without words go."""
    return substrings.dedup_table(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights: a row for each pass over a document."""
    return mixing.mixed_table(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("minhash_dedup", minhash_dedup), ("substring_dedup", substring_dedup), ("mix_to_weights", mix_to_weights), ("pack", pack)]

#: Compression, sketches, seeded draws and token ids are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
