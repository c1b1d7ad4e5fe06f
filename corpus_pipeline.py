"""The corpus pipeline: stages over `documents`, each written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import bpe, minhash, mixing, toxicity
from arbora.llm.common import placed, written
from arbora.llm.queries import MIX, vocabulary_path
from arbora.session import table


def detoxified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the classifier chain rejects go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group linked at 0.8 on five-word shingles the smallest doc_id stays."""
    return minhash.deduplicated(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document, written in an order that interleaves the sources by their own shares."""
    mixed = mixing.mix(docs, block_rows=MIX["block_rows"])
    return mixed.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset").select(docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: ids of every whole text, with digests of the ids and of what they decode to.

    ``mix_part`` and ``mix_row`` say where the mixture has the document: rows sorted by them are the mixture.
    """
    return bpe.digests(placed(docs, "mix_part", "mix_row"), vocabulary_path(), with_ids=True, keep=("mix_part", "mix_row"))


STAGES = [("toxicity", detoxified), ("minhash", deduplicated), ("mixing", mixture), ("bpe", tokenized)]

#: SQL can't express training a classifier, so there is none; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
