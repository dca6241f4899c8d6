"""Transaction sources and scans (A-1..A-5).

Transactions arrive as JSON or Parquet files with the nested RPC shape
(``derived.TX_SCHEMA``); the schema is always given, never inferred. Slot
filters are plain predicates, so they reach the Parquet scan and prune
``slot_bucket`` partitions when the table is written partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.sources.derived import TX_SCHEMA

SLOT_BUCKET = 216000  # slots per partition bucket (about one day)


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A-1: read a transaction table; rows without a transaction body are dropped."""
    r = spark.read.schema(TX_SCHEMA)
    df = r.json(path) if fmt == "json" else r.parquet(path)
    return scan(df)


def scan(tx: DataFrame) -> DataFrame:
    """A-1: ``fetchTx`` returned null -> the row is skipped."""
    return tx.where(F.col("transaction").isNotNull() & F.col("signature").isNotNull())


def write_transactions(tx: DataFrame, path: str, mode: str = "append") -> None:
    """Store transactions partitioned by slot bucket, sorted by slot inside files, with Bloom filters on the signature."""
    # range partitioning: a busy bucket is split over several writer tasks by slot
    (tx.withColumn("slot_bucket", F.floor(F.col("slot") / SLOT_BUCKET).cast("bigint"))
       .repartitionByRange("slot_bucket", "slot").sortWithinPartitions("slot", "tx_index")
       .write.mode(mode).option("parquet.bloom.filter.enabled#signature", "true").partitionBy("slot_bucket").parquet(path))


def slot_range(tx: DataFrame, from_slot: int | None = None, to_slot: int | None = None) -> DataFrame:
    """A-2: both ends inclusive. With a partitioned table the bucket bound prunes files."""
    cond = F.lit(True)
    if from_slot is not None:
        cond = cond & (F.col("slot") >= F.lit(from_slot))
        if "slot_bucket" in tx.columns:
            cond = cond & (F.col("slot_bucket") >= F.lit(from_slot // SLOT_BUCKET))
    if to_slot is not None:
        cond = cond & (F.col("slot") <= F.lit(to_slot))
        if "slot_bucket" in tx.columns:
            cond = cond & (F.col("slot_bucket") <= F.lit(to_slot // SLOT_BUCKET))
    return tx.where(cond)


def by_signatures(tx: DataFrame, signatures: DataFrame) -> DataFrame:
    """A-3 / H-3: transactions whose signature is listed; missing ones are skipped.

    A semi join: Spark broadcasts the list when its measured size is under
    the broadcast threshold (AQE re-plans at run time), else shuffles both.
    """
    return tx.join(signatures.select("signature"), "signature", "left_semi")


def since_checkpoint(tx: DataFrame, last_slot: int, max_rows: int | None = None) -> DataFrame:
    """A-4 + G-6: rows with ``slot > last``, oldest first. ``max_rows`` reproduces the
    reference's capped backfill (newest rows kept); None processes everything."""
    t = tx.where(F.col("slot") > F.lit(last_slot))
    if max_rows is not None:
        t = t.orderBy(F.col("slot").desc(), F.col("tx_index").desc(), F.col("signature").desc()).limit(max_rows)
    return t.orderBy("slot", "tx_index", "signature")


def poll_latest(tx: DataFrame, last_slot: int, listed: int = 20) -> DataFrame:
    """A-5: the newest ``listed`` rows, then those above the checkpoint, oldest first.
    The limit applies *before* the filter, as in the reference poll."""
    newest = tx.orderBy(F.col("slot").desc(), F.col("tx_index").desc(), F.col("signature").desc()).limit(listed)
    return newest.where(F.col("slot") > F.lit(last_slot)).orderBy("slot", "tx_index", "signature")


def flat(tx: DataFrame) -> DataFrame:
    """Flat view of a transaction row for reports."""
    return tx.select("signature", "slot", "tx_index", F.col("blockTime").alias("block_time"),
                     (F.col("meta").isNotNull() & F.col("meta.err").isNull()).alias("ok"))
