"""F-1..F-9 / G-4 from maintained partial states instead of all instruction rows.

Each batch adds one row per (instruction type, hour) it has rows of: their
count, first and last slot, and for every argument the count, sum, minimum and
maximum of its numeric values. These states merge by sum, min and max, so hours,
days and totals are read from them alone; a store bucket that has gathered
several batches is rewritten as its merged states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.operators import query as Q
from progscan.streaming.bucket_store import BucketStore

BUCKETS = 16
KEY = ["ix_name", "hour"]
_PARTS = {"n": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _fields(columns: list[str]) -> list[str]:
    return [c[:-len("__n")] for c in columns if c.endswith("__n")]


def partial_states(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One state per (ix_name, hour) of instruction rows."""
    aggs = [F.count(F.lit(1)).alias("count"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")]
    for f in fields:
        x = Q.numeric(f)
        aggs += [F.count(x).alias(f"{f}__n"), F.sum(x).alias(f"{f}__sum"), F.min(x).alias(f"{f}__min"), F.max(x).alias(f"{f}__max")]
    return rows.groupBy("ix_name", Q.bucket_column("hour").alias("hour")).agg(*aggs)


def merged(states: DataFrame, by: list) -> DataFrame:
    """States merged to one per group."""
    aggs = [F.sum("count").alias("count"), F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot")]
    aggs += [how(f"{f}__{part}").alias(f"{f}__{part}") for f in _fields(states.columns) for part, how in _PARTS.items()]
    return states.groupBy(*by).agg(*aggs)


class Rollups:
    """The states under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = BucketStore(spark, root)

    def add(self, rows: DataFrame, version: int) -> None:
        """Add a batch's instruction rows; their arguments are the ``arg_`` columns."""
        fields = [c for c in rows.columns if c.startswith("arg_")]
        bucket = F.pmod(F.xxhash64("ix_name", F.expr("hour div 24")), F.lit(BUCKETS)).cast("int")
        self.store.write(partial_states(rows, fields).withColumn("bucket", bucket), version, False,
                         lambda s: merged(s, [*KEY, "bucket"]))

    def aggregate(self, ix_name: str, group_by: str = "total", op: str = "count", field: str | None = None) -> DataFrame:
        """As ``query.aggregate`` over all rows of the type: same columns, newest buckets first."""
        if op not in Q.AGG_OPS:
            raise ValueError(f"unknown op {op}")
        states = self.store.read()
        if states is None:
            raise FileNotFoundError(f"{self.store.root} holds no data")
        states = states.where(F.col("ix_name") == ix_name)
        if op == "count" or not field:
            value = F.col("count")
        elif field not in _fields(states.columns):
            raise ValueError(f"no such column: {field}")
        else:
            value = F.try_divide(f"{field}__sum", f"{field}__n") if op == "avg" else F.col(f"{field}__{op}")
        if group_by == "total":
            return merged(states, []).select(F.coalesce(value, F.lit(0)).alias("value") if op == "count" else value.alias("value"),
                                             F.coalesce("count", F.lit(0)).alias("total_calls"), "first_slot", "last_slot")
        day = F.call_function("div", F.col("hour") - F.pmod(F.col("hour"), F.lit(24)), F.lit(24))
        at = {"hour": F.col("hour"), "day": day}[group_by].cast("bigint")
        out = merged(states, [at.alias("bucket")]).select("bucket", value.alias("value"), "count")
        return out.orderBy(F.col("bucket").desc()).limit(Q.HOUR_BUCKETS if group_by == "hour" else Q.DAY_BUCKETS)
