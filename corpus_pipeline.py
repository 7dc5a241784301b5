"""A corpus pipeline of five stages, each a DataFrame written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from whetstone.llm import bpe, jaccard, lines, mixing, rules
from whetstone.llm.common import intermediates, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled cutoffs reject go.

    Null, empty and wordless texts fail the base rules. Repeated rows are judged alike and stay as many as pass; rows without
    an id go. No rows give none, and further columns of any names stay as they are: both hold for every stage but the last.
    """
    return rules.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document or an earlier line has nearly word for word go, and documents of which nothing is left.

    Null and empty texts lose nothing. Repeated rows share their verdicts: k rows stay k rows.
    """
    return lines.apply_line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, and one of repeated rows. Texts without a word are in no class and stay."""
    return jaccard.one_per_class(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice. Repeated rows are taken each by itself; texts without a word are not."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, for every row of the mix.

    Null and empty texts have no tokens. Repeated rows and rows without an id are rows like others; texts of any length are encoded whole.
    No rows give none; further columns of any names are left behind.
    """
    return bpe.tokenised(docs, digests=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing_sources), ("bpe", tokens)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/whetstone-stage-{uuid.uuid4().hex}"
        with intermediates(spark):  # once the stage is written, what led to it can go
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
