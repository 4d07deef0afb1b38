"""The queries of this subpackage's operators, over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_tree, grammar, hyperdim, maxent, packing, pii, quality, ranked, repair, secrets
from .common import crc_mod, documents, written
from .fingerprints import fingerprints_of_edits
from .jaccard_join import linked_classes


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(documents(spark, sf_dir), crc_mod("doc_id", 7) == 2)


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", crc_mod("doc_id", 3) == 1)
    rows = written(quality.with_features(docs, "doc_id", "held_out"), "features")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 3) != 1)
    return quality.scored(rows, quality.learn(rows.where("not held_out"), labels))


def op3_repair_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", crc_mod("doc_id", 5) == 0)
    return hyperdim.predict(docs, hyperdim.learn(docs.where("not held_out")), "doc_id", "held_out")


def op7_bottom_k_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_of_edits(documents(spark, sf_dir))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(documents(spark, sf_dir))


def op9_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encoded_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op11_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.edited(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_maxent_lm, op2_pu_quality, op3_repair_token_blocks, op4_ivf_pq_search, op5_secret_scan, op6_hyperdimensional_language, op7_bottom_k_fingerprint, op8_ngram_jaccard_join, op9_tree_bpe, op10_best_fit_packing, op11_pii_spans, op12_stratified_search, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    """SQL has no BPE, regular vectors or iteration to express the others; tests hold them against brute force."""
    return {"op11_pii_spans": pii.SQL, "op12_stratified_search": ranked.SQL}
