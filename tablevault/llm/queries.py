"""One query per operator, over its whole table, and the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevault.llm import (
    decontamination,
    fertility,
    html_trees,
    licenses,
    line_chunks,
    oracles,
    packing,
    prefix_trie,
    probminhash,
    repairs,
    sentencepieces,
    sharding,
    suffix_buckets,
    urls,
)
from tablevault.llm.common import table


def op1_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_trees.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


def op4_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probminhash.classify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "links", "is_first")


def op7_sentencepiece_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.col("pieces.n_tokens").alias("n_tokens"),
                        F.col("pieces.n_byte_tokens").alias("n_byte_tokens"), F.col("pieces.ids").alias("ids"),
                        F.col("pieces.round_trip").alias("round_trip"), F.col("pieces.parity").alias("parity"))


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = suffix_buckets.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rest.select("row.doc_id", "rest.n_bytes", "rest.n_removed", "rest.n_spans", "rest.kept_sha256")


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), stats=True)


def op11_cyk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.repaired(repairs.damaged(table(spark, sf_dir, "conversations")))


def op12_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_trees, op2_label_propagation_shards, op3_tokeniser_fertility,
                            op4_benchmark_alignment, op5_license_set_join, op6_probminhash,
                            op7_sentencepiece_tokenizers, op8_url_trees, op9_suffix_buckets, op10_line_chunks,
                            op11_cyk_repair, op12_sum_of_squares_packing, op13_prefix_trie)}

ORACLES: dict[str, str] = {"op11_cyk_repair": oracles.repair(), "op13_prefix_trie": oracles.trie()}
