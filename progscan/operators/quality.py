"""Completeness and health: gaps, lag, late rows, counters, histograms.

All of these are aggregates or joins; none needs a window over a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
TX_LATENCY_BOUNDS_MS = [1, 5, 10, 25, 50, 100, 250, 500, 1000]
RPC_LATENCY_BOUNDS_MS = [10, 50, 100, 250, 500, 1000, 2000, 5000]
DEFAULT_BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5]


def gaps(listing: DataFrame, processed: DataFrame, on: str = "slot") -> DataFrame:
    """H-2: listed rows not processed.

    ``on="slot"`` is the reference's rule (a missed transaction inside a slot
    that was seen stays missed); ``on="signature"`` closes that hole. At scale
    this is a shuffled anti join on the key (AQE may broadcast a small side).
    """
    return listing.join(processed.select(on), on, "left_anti")


def slot_lag(listing: DataFrame, processed: DataFrame) -> DataFrame:
    """J-7: chain tip minus last processed slot, only when both are positive."""
    u = listing.select("slot", F.lit(True).alias("__tip")).unionByName(
        processed.select("slot", F.lit(False).alias("__tip")))
    out = u.agg(F.max(F.when(F.col("__tip"), F.col("slot"))).alias("chain_slot"),
                F.max(F.when(~F.col("__tip"), F.col("slot"))).alias("last_processed_slot"))
    return out.select("chain_slot", "last_processed_slot",
                      F.when((F.col("chain_slot") > 0) & (F.col("last_processed_slot") > 0),
                             F.col("chain_slot") - F.col("last_processed_slot")).alias("slot_lag"))


#: Prefixes of the batch order are put together from blocks of 1, 2, 4, ... batches, up to 2^40 of them.
LEVELS = 41


def late_rows(rows: DataFrame, batch_col: str, ok_col: str = "ok") -> DataFrame:
    """J-6: rows whose slot is at or below the checkpoint left by earlier batches.

    The checkpoint before batch b is the max slot of the ok rows of batches
    < b. It needs no window over all batches: each batch's max counts for its
    block of every dyadic size, and the batches before b are those of at most
    ``LEVELS`` such blocks (one per bit of b), which meet in an equi-join. Batch
    numbers are integers; those whose batches before have no ok row, and rows
    without a batch, are never late.
    """
    b = F.col(batch_col).cast("bigint") + F.lit(1 << 39)
    shift = lambda x, level: F.expr(f"shiftright({x}, {level})")
    per = rows.where(F.col(batch_col).isNotNull()).groupBy(batch_col).agg(
        F.max(F.when(F.col(ok_col), F.col("slot"))).alias("__m")).withColumn("__n", b)
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    blocks = (per.where("__m IS NOT NULL").select("__n", "__m", F.explode(levels).alias("__level"))
              .select("__level", shift("__n", "__level").alias("__block"), "__m")
              .groupBy("__level", "__block").agg(F.max("__m").alias("__m")))
    # a set bit of b stands for the block of that size just before b's own, once the lower bits are cut off
    cover = (per.select(batch_col, "__n", F.explode(levels).alias("__level"))
             .where(shift("__n", "__level").bitwiseAND(F.lit(1)) == 1)
             .select(batch_col, "__level", (shift("__n", "__level") - 1).alias("__block")))
    ck = (cover.join(blocks, ["__level", "__block"]).groupBy(batch_col).agg(F.max("__m").alias("checkpoint")))
    return rows.join(ck, batch_col, "inner").where(F.col("slot") <= F.col("checkpoint"))


def labelled_counts(df: DataFrame, metric: str, label_col: str) -> DataFrame:
    """F-13: one counter family: (metric, label, value)."""
    return df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit(metric).alias("metric"), "label", "value")


def histogram(df: DataFrame, col: str, bounds: list[float]) -> DataFrame:
    """F-14: cumulative counts ``x <= b`` per bound, ``+Inf``, sum and count (one pass).

    Columns: series ('bucket'|'sum'|'count'), le, value.
    """
    x = F.col(col)
    aggs = [F.count_if(x <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(x).alias("total"), F.sum(x.cast("decimal(38,6)")).cast("double").alias("sum")]
    a = df.agg(*aggs)
    rows = [F.struct(F.lit("bucket").alias("series"), F.lit(_fmt(b)).alias("le"),
                     F.col(f"b{i}").cast("double").alias("value")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("bucket").alias("series"), F.lit("+Inf").alias("le"),
                         F.col("total").cast("double").alias("value")))
    rows.append(F.struct(F.lit("sum").alias("series"), F.lit(None).cast("string").alias("le"),
                         F.col("sum").alias("value")))
    rows.append(F.struct(F.lit("count").alias("series"), F.lit(None).cast("string").alias("le"),
                         F.col("total").cast("double").alias("value")))
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _fmt(b: float) -> str:
    return str(int(b)) if float(b).is_integer() else str(b)
