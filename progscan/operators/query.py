"""Read-side operators: filters, keyset pages, bucketed aggregates, stats.

Pages use ``orderBy(...).limit(n + 1)`` which Spark plans as
TakeOrderedAndProject (a per-partition top-n then a merge), never a full
sort. The keyset predicate is a plain boolean Column, so it reaches the
Parquet scan as a data filter; the redundant ``slot >= s`` conjunct lets
row-group statistics and slot-bucket partitions be skipped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from progscan.functions.codec import SAFE_COLUMN_PATTERN, cursor_decode_py, cursor_encode_py, cursor_signature_py

# Fixed values that must equal the reference's for the same results.
DEFAULT_PAGE = 50
MAX_PAGE = 200
HOUR_SECONDS, HOUR_SLOTS, HOUR_BUCKETS = 3600, 9000, 168
DAY_SECONDS, DAY_SLOTS, DAY_BUCKETS = 86400, 216000, 30
AGG_OPS = ("count", "sum", "avg", "min", "max")

_SAFE = re.compile(SAFE_COLUMN_PATTERN)


class UnsafeName(ValueError):
    pass


def page_size(limit: int | None) -> int:
    return min(limit if limit is not None else DEFAULT_PAGE, MAX_PAGE)


def slot_range(df: DataFrame, slot_from: int | None = None, slot_to: int | None = None,
               zero_is_absent: bool = False) -> DataFrame:
    """C-5: inclusive slot bounds. Events/aggregates treat 0 as absent (``zero_is_absent``)."""
    def present(v):
        return v is not None and not (zero_is_absent and v == 0)

    if present(slot_from):
        df = df.where(F.col("slot") >= F.lit(slot_from))
    if present(slot_to):
        df = df.where(F.col("slot") <= F.lit(slot_to))
    return df


def equality_filters(df: DataFrame, filters: dict) -> DataFrame:
    """C-6: ``col = value`` AND-ed; unsafe keys ignored, NULL values skipped,
    ``slot_from``/``slot_to`` are range bounds; an unknown column is an error."""
    for key, val in filters.items():
        if val is None:
            continue
        if key == "slot_from":
            df = df.where(F.col("slot") >= F.lit(val))
            continue
        if key == "slot_to":
            df = df.where(F.col("slot") <= F.lit(val))
            continue
        if not _SAFE.match(key):
            continue
        if key not in df.columns:
            raise ValueError(f"no such column: {key}")
        df = df.where(F.col(key) == F.lit(val))
    return df


def keyset_predicate(slot: int, id_: int, slot_col: str = "slot", id_col: str = "id",
                     signature: str | None = None) -> Column:
    """C-9: rows after (slot, id), plus ``slot >= s`` for pruning. With a signature, also the rows
    of the same (slot, id) behind it."""
    s, i = F.lit(slot), F.lit(id_)
    after = F.col(id_col) > i
    if signature is not None:
        after = after | ((F.col(id_col) == i) & (F.col("signature") > F.lit(signature)))
    return (F.col(slot_col) >= s) & ((F.col(slot_col) > s) | ((F.col(slot_col) == s) & after))


def _page_order(df: DataFrame) -> list[str]:
    """(slot, id), and the signature where ids of a slot may meet (records without a transaction order)."""
    return ["slot", "id", "signature"] if "signature" in df.columns else ["slot", "id"]


@dataclass
class Page:
    rows: DataFrame          # at most ``limit`` rows, ordered by (slot, id)
    total: int | None
    next_cursor: str | None


def page_frame(df: DataFrame, limit: int | None = None, cursor: str | None = None,
               filters: dict | None = None) -> tuple[DataFrame, int]:
    """G-1 plan: the ``limit + 1`` probe rows after the cursor (lazy)."""
    n = page_size(limit)
    if filters:
        df = equality_filters(df, filters)
    cur = cursor_decode_py(cursor)
    if cur is not None:
        df = df.where(keyset_predicate(*cur, signature=cursor_signature_py(cursor)))
    return df.orderBy(*_page_order(df)).limit(n + 1), n


def page(df: DataFrame, limit: int | None = None, cursor: str | None = None, filters: dict | None = None,
         with_total: bool = False) -> Page:
    """G-1 / G-2: one page and its envelope; at most ``limit + 1`` rows reach the driver."""
    probe, n = page_frame(df, limit, cursor, filters)
    rows = probe.collect()
    has_more = len(rows) > n
    kept = rows[:n]
    nxt = None
    if has_more and kept:
        last, peek = kept[-1], rows[n]
        tie = "signature" in probe.columns and (last["slot"], last["id"]) == (peek["slot"], peek["id"])
        nxt = cursor_encode_py(last["slot"], last["id"], last["signature"] if tie else None)
    spark = df.sparkSession
    out = spark.createDataFrame(kept, probe.schema)
    total = filtered_total(df, filters).collect()[0][0] if with_total else len(kept)
    return Page(out, total, nxt)


def filtered_total(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """F-12: match count with the filters, without the cursor."""
    if filters:
        df = equality_filters(df, filters)
    return df.agg(F.count(F.lit(1)).alias("total"))


def history_page(history: DataFrame, pubkey: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """G-3: one account's history, newest slot first, limit/offset."""
    n = page_size(limit)
    h = history.where(F.col("pubkey") == F.lit(pubkey)).orderBy(F.col("slot").desc(), F.col("id").desc())
    return h.offset(offset).limit(n) if offset else h.limit(n)


# -------------------------------------------------------------- aggregates --

def _floor_div(col: str, by: int) -> Column:
    """Integer division that rounds down, also below zero; no detour over doubles."""
    c = F.col(col).cast("bigint")
    return F.call_function("div", c - F.pmod(c, F.lit(by).cast("bigint")), F.lit(by).cast("bigint"))


def bucket_column(group_by: str) -> Column:
    """E-28: epoch-time bucket, or slot bucket when the block time is missing (Q-9)."""
    if group_by == "hour":
        return F.coalesce(_floor_div("block_time", HOUR_SECONDS), _floor_div("slot", HOUR_SLOTS))
    if group_by == "day":
        return F.coalesce(_floor_div("block_time", DAY_SECONDS), _floor_div("slot", DAY_SLOTS))
    raise ValueError(group_by)


def numeric(col: str) -> Column:
    """E-27: stored text -> DOUBLE; dirty text becomes NULL (Q-10)."""
    return F.col(col).try_cast("double")


def aggregate(df: DataFrame, group_by: str = "total", op: str = "count", field: str | None = None,
              slot_from: int | None = None, slot_to: int | None = None, numeric_type: str = "double",
              bucket_basis: bool = False) -> DataFrame:
    """F-1..F-9: COUNT/SUM/AVG/MIN/MAX by hour, day or total.

    hour/day: columns (bucket, value, count), newest 168 / 30 buckets.
    total: one row (value, total_calls, first_slot, last_slot).
    ``numeric_type="decimal"`` sums exact integers (Q-11); ``bucket_basis``
    splits time-derived from slot-derived buckets (Q-9) with a ``basis`` column.
    """
    if op not in AGG_OPS:
        raise ValueError(f"unknown op {op}")
    df = slot_range(df, slot_from, slot_to, zero_is_absent=True)
    if op == "count" or not field:
        value = F.count(F.lit(1))
    else:
        if not _SAFE.match(field):
            raise UnsafeName(f"Unsafe field name: {field}")
        x = F.col(field).try_cast("decimal(38,0)") if numeric_type == "decimal" else numeric(field)
        value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](x)
    if group_by == "total":
        return df.agg(value.alias("value"), F.count(F.lit(1)).alias("total_calls"),
                      F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    limit = HOUR_BUCKETS if group_by == "hour" else DAY_BUCKETS
    keys = [bucket_column(group_by).alias("bucket")]
    if bucket_basis:
        keys.append(F.when(F.col("block_time").isNull(), F.lit("slot")).otherwise(F.lit("time")).alias("basis"))
    out = df.groupBy(*keys).agg(value.alias("value"), F.count(F.lit(1)).alias("count"))
    if bucket_basis:
        # the newest buckets, each with both its rows: a bounded list of bucket numbers
        newest = out.select("bucket").distinct().orderBy(F.col("bucket").desc()).limit(limit)
        return out.join(newest, "bucket", "left_semi").orderBy(F.col("bucket").desc(), "basis")
    return out.orderBy(F.col("bucket").desc()).limit(limit)


def instruction_stats(decoded: DataFrame, names: list[str]) -> DataFrame:
    """F-10: per instruction of the IDL: total, first_slot, last_slot (0 when absent)."""
    spark = decoded.sparkSession
    agg = decoded.groupBy("ix_name").agg(F.count(F.lit(1)).alias("total"), F.min("slot").alias("first_slot"),
                                         F.max("slot").alias("last_slot"))
    idl_names = spark.createDataFrame([(n,) for n in names], "ix_name string")
    out = idl_names.join(agg, "ix_name", "left")
    return out.select("ix_name", F.coalesce("total", F.lit(0)).alias("total"), "first_slot", "last_slot")


def event_counts(events: DataFrame) -> DataFrame:
    """F-11."""
    return events.groupBy("event_name").agg(F.count(F.lit(1)).alias("count"))


def recent_activity(decoded: DataFrame, names: list[str], per_type: int = 5, total: int = 20,
                    true_recent: bool = False) -> DataFrame:
    """G-5: first three instruction types; ``per_type`` rows each from their first
    (ascending) page -- or the newest ones with ``true_recent`` -- merged, newest first."""
    first3 = names[:3]
    d = decoded.where(F.col("ix_name").isin(first3))
    from pyspark.sql import Window

    o = [F.col("slot").desc(), F.col("id").desc()] if true_recent else [F.col("slot"), F.col("id")]
    w = Window.partitionBy("ix_name").orderBy(*o)
    d = d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_type).drop("__rn")
    return d.orderBy(F.col("slot").desc(), F.col("id").desc()).limit(total)
