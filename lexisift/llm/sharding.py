"""Sharding by rendezvous hashing: the record goes to the shard with the highest score for its key.

The score of a shard with weight w is -w / ln(u), where u in (0, 1) comes from a hash of key and shard. A record's
scores for the old shards do not change when a shard is added, so it either stays or moves to the new one.

Defined cases: a null key hashes as the empty string; a null text has size 1 and the CRC of nothing; equal keys go to
one shard, in slots of their own; an empty table gives an empty result. Other columns pass through ``assigned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import rank_within

SHARDS = 16


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from 48 bits of a hash of key and shard."""
    bits = F.conv(F.substr(F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), F.lit(shard))), F.lit(1), F.lit(12)), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def shard_of(key: Column, weights: list[float]) -> Column:
    scores = F.array(*[F.struct((F.lit(-float(w)) / F.ln(uniform(key, i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)])
    return (-F.array_max(scores)["shard"]).cast("int")


def assigned(df: DataFrame, key: str = "doc_id", weights: list[float] | None = None, out: str = "shard") -> DataFrame:
    return df.withColumn(out, shard_of(F.col(key), weights or [1.0] * SHARDS))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    df = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    df = assigned(assigned(df, weights=[1.0] * shards), weights=[1.0] * (shards + 1), out="grown_shard")
    df = df.withColumn("_bucket", F.substr(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1), F.lit(3)))
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    return rank_within(df, "shard", "_bucket", order, "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql(shards: int = SHARDS) -> str:
    u = lambda i: f"((('0x' || substr(md5(k || '/{i}'), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE)"
    top = lambda n: "list_position(s{0}, list_max(s{0}))::INT - 1".format(n)
    scores = lambda n: "[" + ", ".join(f"-1::DOUBLE / ln({u(i)})" for i in range(n)) + "]"
    return f"""
WITH d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
s AS (SELECT *, {scores(shards)} AS s{shards}, {scores(shards + 1)} AS s{shards + 1} FROM d),
a AS (SELECT *, {top(shards)} AS shard, {top(shards + 1)} AS grown_shard FROM s)
SELECT doc_id, size, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, 3), doc_id, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard FROM a"""


SQL = None  # DuckDB has no CRC-32; tests/llm/test_columns.py holds all other columns against _sql()
