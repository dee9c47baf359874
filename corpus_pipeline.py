"""Five steps from raw documents to packed training sequences, each on what the one before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import exact_dedup, jaccard, mixing, packing, queries, toxicity
from sedimenta.sources.hfs import drop_table, shared_dir, shuffles_dropped, stage_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.score(docs, queries.toxicity_model(spark, docs, sf_dir), "score", docs.columns, keep_below=0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by five-word shingles with a similarity of 0.8 or more the smallest id stays."""
    groups = jaccard.similar_groups(docs, words=5, num=80, den=100)
    gone, _ = stage_table(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone_id")).distinct(), "gone")
    gone = gone.hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 1024 tokens."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the classifier, nor the tokenizer; tests hold the stages, and all of :func:`run`, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again by the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        with shuffles_dropped(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if last:
            drop_table(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
