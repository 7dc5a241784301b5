"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whetstone.llm import bpe, chat, embeddings, jaccard, lines, merkle, mixing, packing, quality_cnn, resampling, rules, sharding, suffix


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_read(spark, sf_dir, "documents"), digests=True).withColumnRenamed("kept", "kept_sha256")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_read(spark, sf_dir, "conversations"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(_read(spark, sf_dir, "documents"), digests=True).withColumnRenamed("kept", "kept_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenised(_read(spark, sf_dir, "documents"), digests=True)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), digests=True)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    hit = F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % 3 == 0
    return merkle.audited(docs, {"text": F.when(hit, merkle.lower_ascii(docs["text"])).otherwise(docs["text"])})


def queries() -> dict:
    named = (op1_mixing, op2_quality_classifier, op3_line_dedup, op4_sharding, op5_chat_formatting, op6_embedding_dedup, op7_suffix_dedup, op8_quality_rules, op9_jaccard_join, op10_bpe, op11_packing, op12_resampling, op13_merkle)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": chat.ORACLE, "op12_resampling": resampling.ORACLE, "op13_merkle": merkle.ORACLE}
