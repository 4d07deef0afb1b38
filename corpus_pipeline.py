"""A training-data pipeline over documents: five stages, each an operator of trialweave.llm.

Each stage takes all that its predecessor kept and writes Parquet in the shared folder, from
where the next one reads it. All but the last return the columns of documents, whatever these
are beside doc_id, text, lang and n_chars: while operators add columns, others have names of
their own. Rows are told apart by number, not by doc_id: several texts may share one, or have none.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import hyperdim, jaccard_join, packing, quality, secrets
from trialweave.llm.common import crc_mod, documents, small_batches, written

_USED = ("doc_id", "text", "lang", "n_chars")


def _renamed(docs: DataFrame) -> DataFrame:
    """docs with other names for the columns that no stage reads."""
    return docs.toDF(*(c if c in _USED else f"other{i}" for i, c in enumerate(docs.columns)))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows of what _renamed() makes of it."""
    return rows.select(*_renamed(docs.limit(0)).columns).toDF(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs, renamed, with a number ``row``, written so that it stays the same."""
    return written(_renamed(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")


def _frugal(stage):
    """A stage whose Arrow batches, and those of all that follows in the session, are small."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_frugal
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model predicts to be of quality; it learns as op2 does."""
    learned = docs.where(crc_mod("doc_id", 3) != 1)
    rows = written(quality.with_features(learned, "doc_id"), "features")
    model = quality.learn(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 3) != 1))
    return quality.kept(docs, model)


@_frugal
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learned; lang is what is predicted where it was null.

    Rejected are texts without letters and those whose cosine is below what texts of their length have
    (by documents that weren't learned from) and within what a text in none of the languages has by chance.
    """
    held_out = crc_mod("doc_id", 5) == 0
    prototypes = hyperdim.learn(docs.where(~held_out))
    least = hyperdim.least_cosines(docs.where(held_out), prototypes)
    rows = hyperdim.predict(_renamed(docs), prototypes, *(c for c in _renamed(docs).columns if c != "text"), with_text=True)
    rows = rows.where((F.col("lang_pred") != "und") & hyperdim.reaches(least)).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return _named(rows, docs)


@_frugal
def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id (any rather than none). Texts without words stay."""
    rows = _numbered(docs)
    return _named(rows.join(jaccard_join.representatives(rows), "row", "left_semi"), docs)


@_frugal
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that are found taken out of their texts."""
    rows = _numbered(docs)
    return _named(secrets.redacted(rows, secrets.scan(rows.select(F.col("row").alias("doc_id"), "text")), key="row"), docs)


@_frugal
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens."""
    return packing.packed(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=False))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join_stage),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither the models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
