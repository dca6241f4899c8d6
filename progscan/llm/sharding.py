"""Operator 10: shards by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair gets a hash u in (0, 1) and the cost -ln(u) / weight;
a record goes to its cheapest shard (the other way round, the first of
competing exponential clocks rings at shard s with probability weight_s / sum).
Costs of the old shards do not depend on the others, so a new shard only takes
the records for which it is the cheapest, and a removed one only gives up its
own. No state, no shuffle: the shard is a projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from progscan.llm.common import hash_unit, table, temp_names, text_or_empty
from progscan.llm.registry import job

#: Slots are counted in blocks of about so many records, so that no shard is numbered by one task.
SLOT_BLOCK = 20_000


def rendezvous(key: Column, weights: dict[int, float], seed: str = "shard") -> Column:
    """The shard (int) of a record key. Equal costs go to the smaller shard id.

    ``weights``: positive weight per shard id; a shard with weight 2 gets twice
    the records of one with weight 1. A null key is a key like any other.
    """
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("every shard needs a positive weight")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    costs = [F.struct((-F.log(hash_unit(F.lit(seed), text, F.lit(str(s)))) / F.lit(float(w))).alias("cost"),
                      F.lit(int(s)).alias("shard"))
             for s, w in sorted(weights.items())]
    return F.array_min(F.array(*costs))["shard"]


def with_slots(df: DataFrame, shard: str, key: str, ties: list[str], slot: str = "slot",
               block_rows: int = SLOT_BLOCK) -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... without gaps, in a random order fixed by the keys.

    The order is that of a hash u in (0, 1) of the key, then the key and the
    ``ties`` columns; rows equal in all of them are interchangeable. A shard may
    hold any number of rows, so it is numbered in blocks: floor(u * blocks). The
    rows per (shard, block) are counted, a running sum over the blocks gives
    each block's first slot, and ``row_number`` runs inside a block. The blocks
    only divide the work: the slots do not depend on their number.
    """
    u, block, first, n = temp_names(df, "u", "block", "first_slot", "n_block")
    blocks = max(1, math.ceil(df.count() / block_rows))
    cut = df.withColumn(u, hash_unit(F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    cut = cut.withColumn(block, F.floor(F.col(u) * blocks))
    before = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = (cut.groupBy(shard, block).agg(F.count(F.lit(1)).alias(n))
              .select(shard, block, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first)))
    inside = Window.partitionBy(shard, block).orderBy(u, key, *ties)
    return (cut.join(counts, [shard, block])
            .withColumn(slot, (F.col(first) + F.row_number().over(inside) - 1).cast("long"))
            .drop(u, block, first))


def shard_records(docs: DataFrame, weights: dict[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every record.

    Null text counts as empty (size 1, CRC 0). Null and repeated keys are
    ordinary: equal keys share a shard. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    t = text_or_empty(text)
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(t) + 1).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(F.col("k"), weights))
    return with_slots(rows, "shard", "k", ["size", "text_crc32"]).withColumnRenamed("k", key)


SHARDS = 8


def _crc32_table() -> str:
    """The 256 remainders of the reflected CRC-32 polynomial, computed by its rule, as a DuckDB list."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ 0xEDB88320 if i & 1 else i >> 1
        out.append(i)
    return "[" + ",".join(map(str, out)) + "]::BIGINT[]"


def _oracle() -> str:
    u = "((('0x' || substr(md5('shard:' || k || ':' || s), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"
    order = "substr(md5('slot:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13)"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce('k' || doc_id::VARCHAR, 'null') AS k FROM documents),
crc AS (
  SELECT doc_id, k, octet_length(encode(t)) + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(t)) + 1),
           lambda i: ('0x' || substr(hex(encode(t)), 2 * i - 1, 2))::BIGINT)),
           lambda a, b: xor(a >> 8, ({_crc32_table()})[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM base),
cost AS (SELECT DISTINCT k, s, -ln({u}) AS c FROM base, range(0, {SHARDS + 1}) r(s)),
best AS (SELECT k, arg_min(s, c) FILTER (WHERE s < {SHARDS}) AS shard, arg_min(s, c) AS grown FROM cost GROUP BY k)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY {order}, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       grown::INTEGER AS grown_shard
FROM crc JOIN best USING (k)"""


@job("op10_rendezvous_shards", _oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    even = {s: 1.0 for s in range(SHARDS)}
    return (shard_records(docs, even)
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                    rendezvous(F.col("doc_id"), even | {SHARDS: 1.0}).alias("grown_shard")))
