"""From raw documents to token ids: quality, toxicity, near-duplicates, benchmark leaks, coding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next stage's documents.  All but the last keep the columns of documents.
Rows whose ``doc_id`` is null have no group and no label: they pass every filter on their
text alone and are kept by the others.  Null and empty texts are kept or dropped by what the models
say of an empty text, are near-copies of each other, hold no benchmark item and have no token.
Repeated rows share their decisions; ties go to the smallest id; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.llm import bpe, decontaminate, near_copies, quality, toxicity
from pulseframe.llm.common import shared_path, stored


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that co-trained text and metadata views reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic spans weigh too much go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    groups = near_copies.near_copies(docs)
    copies = groups.where("doc_id <> component").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as count and digests of ids and decoded text."""
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-pair encoding", encode),
]
# Learned classifiers and merges by rank have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), "pipeline", f"{path}/{i}")
    return docs
