"""A training corpus from raw documents: quality, near copies, benchmark passages, source mix, shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from morphlake.llm.op2_curriculum_mix import curriculum_mix, training_order
from morphlake.llm.op3_sampled_splitters import shard_documents
from morphlake.llm.op4_lsh_forest_join import one_of_each_group
from morphlake.llm.op6_suffix_automaton import decontaminate
from morphlake.llm.op8_additive_quality import keep_good
from morphlake.llm.shared import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of equal and similar ones."""
    return one_of_each_group(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut, without those that are mostly such passages."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is trained on, in training order."""
    return training_order(curriculum_mix(docs), docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place in it."""
    return shard_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Trained scores, signatures and hash orders are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again for the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
