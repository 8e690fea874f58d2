"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import (
    chat, decontaminate, embedding_dup, filter_audit, line_dedup, merkle, near_dup, packing, pii, quality, sharding, simple8b, suffix_dedup,
)
from loamline.llm.common import table
from loamline.stage import stage_folder


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dup(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, d, "documents"))


def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, d, "documents"), report=True)


def op3_embedding_dup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dup.near_vectors(table(spark, d, "embeddings"))


def op4_token_blocks(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{stage_folder(spark)}/token-blocks-{uuid.uuid4().hex}"
    simple8b.write_token_blocks(table(spark, d, "documents"), folder, _tokenizer("word_bpe_49k.json"))
    return simple8b.read_token_blocks(spark, folder)


def op5_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents")).drop("row_key")


ODD = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    return chat.digest_segments(chat.format_turns(turns.unionByName(odd)))


def op7_repeated_passages(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.dedup_passages(table(spark, d, "documents"))


def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_documents(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_contamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("passages", "items", "matches")


def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.verified(table(spark, d, "documents"))


def op12_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, d, "documents"), table(spark, d, "labels"))


def op13_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.assign(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_near_dup, op2_line_dedup, op3_embedding_dup, op4_token_blocks, op5_personal_data, op6_chat_format, op7_repeated_passages, op8_quality, op9_packing, op10_contamination,
                                                                   op11_merkle_manifest, op12_filter_audit, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dup": near_dup.near_dup_sql(), "op2_line_dedup": line_dedup.dedup_sql(), "op6_chat_format": chat.digest_sql(), "op10_contamination": decontaminate.contamination_sql(),
            "op11_merkle_manifest": merkle.merkle_sql(), "op12_filter_audit": filter_audit.audit_sql(), "op13_sharding": sharding.sharding_sql()}
