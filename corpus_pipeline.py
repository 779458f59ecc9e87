"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgatlas.llm import decontamination, near_copies, packing, secrets, toxicity
from orgatlas.llm.queries import tokenizer_path
from orgatlas.llm.shared import materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the grammar is learned from the labelled rows of ``docs``.

    Null and empty texts score as clean and stay, as do rows without doc_id whose text is clean; repeated rows fare alike; without labels the grammar's own weights hold; an empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8 or more) one row stays: the one with the least doc_id, and of
    several rows with that doc_id in one group any one of them. Rows are told apart by doc_id and text, so a row never goes because of
    another's doc_id; rows without doc_id stay."""
    return near_copies.drop_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (see ``decontamination``: three fifths of it, or 13 tokens in a row) go.

    Rows are judged by their text, so copies go together, with or without doc_id; null and empty texts stay; items without id, text or five tokens are not searched; with an empty benchmark all stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; every document stays, with its new length.

    A null text stays null with a null length; texts without secrets are left as they are; repeated rows fare alike; an empty table stays empty."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences: the last stage, whose rows are those of ``op3_packing``.

    A null or empty text is its end mark alone; rows without doc_id are packed like any other; each repeated row is packed; an empty table gives no pieces."""
    return packing.pack(docs, tokenizer_path)


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: SQL can't express the learned grammar, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
