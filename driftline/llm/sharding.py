"""Sharding by jump consistent hashing.

A key jumps from shard to shard: from shard ``b`` it jumps to
``floor((b + 1) / u)``, with ``u`` in (0, 1] drawn from the key and ``b``, until
a jump would leave the shards. No table of the ring is kept, and a shard that is
appended takes rows only into itself (about one in ``n + 1``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.columns import running_start, text_crc32
from driftline.session import written

SEED = 7_205_759


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a key, 0 to ``shards - 1``; null is a key like any other."""
    if shards < 1:
        raise ValueError("there must be a shard")

    def jump(state: Column, _: Column) -> Column:
        at = state["next"]
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(SEED), at), 33) + 1) / F.lit(float(1 << 31))
        moved = F.struct(at.alias("at"), F.floor((at + 1) / u).alias("next"))
        return F.when(at < shards, moved).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["at"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 1000) -> DataFrame:
    """Assign every document to a shard and give it a place in it.

    Returns ``key``, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``law``
    (always ``key``: nothing but the key and the number of shards decides),
    ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (the
    shard under one shard more).

    Null texts have size 16 and CRC 0. Rows with a null key share one shard, rows
    with the same key too; equal rows get different slots. An empty table gives an
    empty result. Other columns are not read.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    slim = written(
        docs.select(
            F.col(key),
            size.alias("size"),
            text_crc32(F.col(text)).alias("text_crc32"),
            jump_shard(F.col(key), shards).alias("shard"),
            jump_shard(F.col(key), shards + 1).alias("grown_shard"),
        ),
        "sharded",
    )
    buckets = max(64, slim.count() // (shards * rows_per_bucket) + 1)
    spread = slim.withColumn("__bucket", F.pmod(F.xxhash64(key, "text_crc32", F.lit(SEED)), F.lit(buckets))).withColumn("__one", F.lit(1).cast("long"))
    order = [F.col(key), F.col("text_crc32"), F.col("size")]
    placed = running_start(spread, ["shard"], "__bucket", order, "__one", "slot")
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write whole rows below ``path/shard=<n>``; appending a shard later moves only its own rows."""
    docs.withColumn("shard", jump_shard(F.col(key), shards)).write.partitionBy("shard").parquet(path)
