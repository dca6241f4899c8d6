"""J-5: the slots seen so far, as merged intervals instead of a growing set.

Processed slots are nearly contiguous, so the islands are few; they are cut at
slot buckets, and a batch rewrites only the buckets it has slots in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from progscan.sources.transactions import SLOT_BUCKET
from progscan.streaming.bucket_store import BucketStore


def _bucket(slot: Column, bucket_slots: int) -> Column:
    return F.floor(slot / bucket_slots).cast("int")


def islands(intervals: DataFrame) -> DataFrame:
    """(bucket, lo, hi): the union of intervals that lie within their bucket, as few intervals as possible."""
    before = Window.partitionBy("bucket").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("bucket").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    reach = intervals.withColumn("reach", F.max("hi").over(before))
    first = reach.withColumn("first", (F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1)).cast("int"))
    return (first.withColumn("island", F.sum("first").over(upto)).groupBy("bucket", "island")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("bucket", "lo", "hi"))


def of_slots(rows: DataFrame, bucket_slots: int = SLOT_BUCKET) -> DataFrame:
    """The islands of a table's slots."""
    slots = rows.select(F.col("slot").alias("lo")).where("lo IS NOT NULL").distinct()
    return islands(slots.select(_bucket(F.col("lo"), bucket_slots).alias("bucket"), "lo", F.col("lo").alias("hi")))


def gaps(listing: DataFrame, intervals: DataFrame, bucket_slots: int = SLOT_BUCKET) -> DataFrame:
    """H-2: listed rows whose slot lies in no interval.

    A range anti-join without a range join: per bucket, the listed slots (each
    once) and the intervals are put in order, and a slot is covered if the
    furthest end of the intervals that begin at or before it reaches it.
    """
    slots = listing.select("slot").where("slot IS NOT NULL").distinct()
    both = intervals.select("bucket", F.col("lo").alias("at"), F.lit(0).alias("kind"), "hi").unionByName(
        slots.select(_bucket(F.col("slot"), bucket_slots).alias("bucket"), F.col("slot").alias("at"),
                     F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("hi")))
    upto = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_slots = (both.withColumn("reach", F.max("hi").over(upto))
                  .where((F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("reach") < F.col("at"))))
                  .select(F.col("at").alias("slot")))
    return listing.join(open_slots, "slot", "left_semi").select(*listing.columns)


class SeenSlots:
    """The stored intervals under a folder."""

    def __init__(self, spark: SparkSession, root: str, bucket_slots: int = SLOT_BUCKET):
        self.store, self.bucket_slots = BucketStore(spark, root), bucket_slots

    def add(self, rows: DataFrame, version: int) -> None:
        """Merge a batch's slots into the buckets they fall into."""
        new = of_slots(rows, self.bucket_slots)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        old = self.store.read(version, touched)
        self.store.write(new if old is None else islands(old.unionByName(new)), version, replace=True)

    def read(self, before: int | None = None) -> DataFrame:
        """(bucket, lo, hi) of all slots seen (before a version)."""
        rows = self.store.read(before)
        spark = self.store.spark
        return rows.select("bucket", "lo", "hi") if rows is not None else \
            spark.createDataFrame([], "bucket int, lo bigint, hi bigint")
