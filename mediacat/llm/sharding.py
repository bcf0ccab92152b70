"""Sharding by weighted rendezvous hashing.

Each (record key, shard) pair gets a uniform number u from a hash; the shard with the
smallest -ln(u) / weight takes the record. A shard's numbers do not depend on the other
shards, so one more shard takes records only into itself, and shard i gets a share of
weight i / sum of weights. Everything runs as built-in column expressions in one scan.

Slots number a shard's rows by (first digits of md5 of the key, key), bucket by bucket, so
a shard that holds a third of all rows is still numbered by many tasks.

Defined cases: a null text counts as empty (size 1, crc32 0); a null key is a key of its
own; rows that share a key share a shard, in an order by text hash
and size; very long texts are hashed whole; equal scores go to the lower shard; an empty table gives no rows; other columns of
the input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import digest_bucket, ranked, table

SHARDS = 8


def cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, with u from the first 52 bits of md5('key:shard'), never 0."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.ln(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int, from 0) that takes a record key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_min(F.array(*[F.struct(cost(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)])).getField("shard")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the shard under `grown` weights."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(F.col(key), weights))
    if grown:
        rows = rows.withColumn("grown_shard", rendezvous(F.col(key), grown))
    return ranked(rows, ["shard"], [key, "text_crc32", "size"], "slot", digest_bucket(F.col(key)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: crc32 by its table of 256 steps, one fold over the bytes of each text.
_CRC = """list_reduce(list_concat([4294967295], list_transform(range(0, strlen(t)::BIGINT), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))"""
SQL = {
    "op3_sharding": f"""
WITH steps AS (SELECT list(s ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS s FROM range(256) r(i))),
costs AS (SELECT doc_id, i, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS cost
  FROM (SELECT DISTINCT doc_id FROM documents), range(9) r(i)),
placed AS (SELECT doc_id, arg_min(i, cost) FILTER (i < 8)::INTEGER AS shard, arg_min(i, cost)::INTEGER AS grown_shard FROM costs GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(text, '') AS t, lower(hex(encode(coalesce(text, '')))) AS h FROM documents)
SELECT doc_id, strlen(t)::BIGINT + 1 AS size, xor({_CRC}, 4294967295)::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 3), doc_id) - 1 AS slot, grown_shard
FROM texts JOIN placed USING (doc_id), steps""",
}
