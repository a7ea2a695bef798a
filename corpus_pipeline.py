"""Corpus pipeline: raw documents to token ids, as stages that each apply one operator to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import bpe, decontam, ngram_join, suffix_dedup, toxicity
from quayside.llm.common import remove_folders, Scratch, scratch_folders
from quayside.llm.queries import VOCABULARY


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, doesn't reject."""
    return toxicity.drop_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the smallest id, of each class of five-word shingle similarity 0.8 or more."""
    return ngram_join.deduplicate(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of more than 50 words that stand in several places."""
    return suffix_dedup.remove_passages(spark, docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return decontam.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every text that is left."""
    return bpe.bpe_encode(spark, docs, VOCABULARY)


STAGES = [("toxicity", toxic), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("benchmark_decontamination", benchmark_passages), ("bpe", tokens)]

#: No SQL can express a trained classifier or byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table ``documents``, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        known = scratch_folders()
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        remove_folders(spark, [f for f in scratch_folders() if f not in known])  # the stage's own, now that its result is written
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
