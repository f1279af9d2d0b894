"""The training-corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written
as Parquet in the shared checkpoint folder and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevault.llm import decontamination, fertility, line_chunks, probminhash, sentencepieces
from tablevault.llm.common import small_batches, table
from tablevault.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's fertility band."""
    small_batches(spark)
    return fertility.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line chunks that stand elsewhere already; those left without a word go."""
    small_batches(spark)
    rest = line_chunks.remove_repeated(docs)
    rest = rest.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\S"))
    return rest.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    small_batches(spark)
    return probminhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    small_batches(spark)
    coded = sentencepieces.encode(docs)
    return coded.select("doc_id", "lang", "source", "n_chars", F.col("pieces.n_tokens").alias("n_tokens"),
                        F.col("pieces.ids").alias("ids"), F.col("pieces.round_trip").alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


#: Tokenisers, signatures and alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
