"""Sharding by proportional stratified interleaving: every shard has the mixture of sources that the whole has.

Rows are shuffled within their source by a seeded digest and ranked; a rank over the source's size is a fraction that says how
far through its source a row stands. In the order of these fractions every stretch holds each source in proportion. That
order is cut into shards of equal counts (at most one apart), and a source is spread over them as evenly as whole
rows allow. Both orders are made by ranges of narrow rows, so a source with a third of all rows takes as many tasks as it
needs; texts are only moved where they are written.

Defined cases: null text has no bytes; a null source is a source of its own; repeated rows are rows of their own and may
part; null doc_ids take part as any other; more shards than rows leave some empty; other columns are ignored by ``assign``
and kept by ``write_shards``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import free
from loamline.llm.ordering import crc32_sql, numbered, order_key
from loamline.stage import stage

#: Bytes of a row besides its text.
OVERHEAD = 16


@dataclass(frozen=True)
class ShardRules:
    shards: int = 40
    seed: int = 42
    stratum: str = "source"

    def __post_init__(self):
        if self.shards < 1:
            raise ValueError("need at least one shard")


def _narrow(docs: DataFrame, rules: ShardRules, uid: str | None = None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    dealt = F.md5(F.concat(F.lit(f"{rules.seed}|"), F.coalesce(doc.cast("string"), F.lit("-")), F.lit("|"), text).cast("binary"))
    return docs.select(
        doc.alias("doc_id"), order_key(F.col(rules.stratum).cast("string")).alias("stratum"), F.unhex(dealt).alias("dealt"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"))


def _assigned(narrow: DataFrame, rules: ShardRules) -> DataFrame:
    ranked = numbered(stage(narrow, "shard-rows"), "stratum", ["dealt", "doc_id", "uid"], "shard-rank")
    ranked = ranked.withColumn("fraction", (F.col("idx") + F.lit(0.5)) / F.col("n")).withColumnRenamed("idx", "rank").drop("dealt", "n")
    placed = numbered(stage(ranked, "shard-ranked"), None, ["fraction", "stratum", "rank"], "shard-order")
    shard = F.expr(f"idx * {rules.shards} div n")
    first = F.expr(f"(shard * n + {rules.shards - 1}) div {rules.shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("idx") - first).select(
        "uid", "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def assign(docs: DataFrame, rules: ShardRules = ShardRules()) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (its place in the shard, from 0) and grown_shard, which only a law by key has."""
    return _assigned(_narrow(docs, rules), rules).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, rules: ShardRules = ShardRules()) -> None:
    """Write all columns of ``docs`` to ``folder``/shard_id=N, with ``shard_slot``; a shard's files are in the order of their slots."""
    uid = free(docs, "uid")
    kept = stage(docs.withColumn(uid, F.monotonically_increasing_id()), "shard-docs")
    where = _assigned(_narrow(kept, rules, uid), rules).select(F.col("uid").alias(uid), F.col("shard").alias("shard_id"), F.col("slot").alias("shard_slot"))
    out = kept.join(where, uid).drop(uid)
    keys = ["shard_id", "shard_slot"]
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("shard_id").parquet(folder)


def sharding_sql(rules: ShardRules = ShardRules()) -> str:
    crc = crc32_sql("list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)")
    return f"""WITH d AS (SELECT doc_id, {crc} AS text_crc32, strlen(coalesce(text, '')) + {OVERHEAD} AS size,
        CASE WHEN {rules.stratum} IS NULL THEN '0' ELSE '1' || {rules.stratum} END AS stratum,
        md5('{rules.seed}|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(text, '')) AS dealt FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY dealt, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM d),
    p AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / n, encode(stratum), rank) - 1 AS idx, count(*) OVER () AS total FROM r),
    s AS (SELECT *, idx * {rules.shards} // total AS shard FROM p)
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, idx - (shard * total + {rules.shards - 1}) // {rules.shards} AS slot, NULL::INT AS grown_shard FROM s"""
