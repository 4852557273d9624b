"""A training-corpus pipeline over the documents table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame, which
is written as Parquet and read again for the next stage. All but the last return the columns of
documents.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, mixing, quality_rules, sharding, shingle_dedup

SHARDS = 16


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the learned decision list rejects go. Without
    label rows only the base rules decide; null and empty texts fail them."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more of their five-word
    shingles, the one with the smallest id stays (null ids last); of fully equal rows, one."""
    return shingle_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten consecutive words of a benchmark item occurs go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to target weights: a row for each document and round that takes
    words of it; a document taken in part has those words as its text."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard, by rendezvous hashing of its id, and its place in the shard. Columns of the
    result: those of documents, shard and slot."""
    return sharding.assign_shards(docs, "doc_id", (1.0,) * SHARDS, tie_break=("n_chars", "text"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_to_targets),
    ("sharding", shard),
]

#: SQL has neither the learned rules nor the draw of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in `sf_dir`; what lies between two stages is written to the
    folder that the cluster shares (spark.checkpoint.dir)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
