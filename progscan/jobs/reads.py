"""Jobs over stored tables: aggregates, pages, filters, stats (F-*, G-*, C-5..9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from progscan.functions.codec import cursor_encode, cursor_encode_py
from progscan.jobs._base import EV, IDL, events, ix_sql, ix_table, ix_where, job, stored
from progscan.operators import query as Q

AGG_TABLE = "purchase"
AGG_FIELD = "arg_amount"
RANGE_FROM, RANGE_TO = 2000, 7000


def _agg_sql(group_by: str, op: str, where: str = "") -> str:
    value = "COUNT(*)" if op == "count" else f"{op.upper()}(TRY_CAST({AGG_FIELD} AS DOUBLE))"
    src = ix_sql(AGG_TABLE)
    if group_by == "total":
        return (f"SELECT {value} AS value, COUNT(*) AS total_calls, MIN(slot) AS first_slot, "
                f"MAX(slot) AS last_slot FROM {src} t {where}")
    secs, slots, lim = (3600, 9000, 168) if group_by == "hour" else (86400, 216000, 30)
    return (f"SELECT COALESCE(block_time // {secs}, slot // {slots}) AS bucket, {value} AS value, "
            f"COUNT(*) AS count FROM {src} t {where} GROUP BY 1 ORDER BY bucket DESC LIMIT {lim}")


def _register_aggs():
    for op in Q.AGG_OPS:
        for g in ("hour", "day", "total"):
            name = f"agg_{op}_{g}"

            def fn(spark, sf, _op=op, _g=g):
                return Q.aggregate(ix_table(spark, sf, AGG_TABLE), _g, _op, AGG_FIELD if _op != "count" else None)

            job(name, _agg_sql(g, op))(fn)


_register_aggs()


@job("agg_sum_day_range", _agg_sql("day", "sum", f"WHERE slot >= {RANGE_FROM} AND slot <= {RANGE_TO}"))
def agg_sum_day_range(spark, sf):
    """F-9: the slot range is applied before grouping."""
    return Q.aggregate(ix_table(spark, sf, AGG_TABLE), "day", "sum", AGG_FIELD, RANGE_FROM, RANGE_TO)


# ------------------------------------------------------------------ stats --

_STATS_SQL = f"""
SELECT n.ix_name, COALESCE(s.total, 0) AS total, s.first_slot, s.last_slot
FROM (VALUES {", ".join(f"('{ix.name}')" for ix in IDL.instructions)}) n(ix_name)
LEFT JOIN (SELECT ix_name, COUNT(*) AS total, MIN(slot) AS first_slot, MAX(slot) AS last_slot
           FROM {ix_where("TRUE")} x GROUP BY ix_name) s
ON n.ix_name = s.ix_name"""


@job("stats_instructions", _STATS_SQL)
def stats_instructions(spark, sf):
    """F-10: every IDL instruction, with 0 for those never seen (``error`` txs all fail)."""
    return Q.instruction_stats(stored(spark, sf), [ix.name for ix in IDL.instructions])


@job("stats_events", f"SELECT event_name, COUNT(*) AS count FROM ({EV}) e GROUP BY event_name")
def stats_events(spark, sf):
    return Q.event_counts(events(spark, sf))


# ------------------------------------------------------------------ pages --

PAGE_TABLE = "click"
PAGE_CURSOR = (5000, 4096)  # (slot, id) of a row in the middle of the table
_PAGE_COLS = "id, signature, slot, block_time, account_user, arg_amount, arg_k"


@job("ix_page_first", f"SELECT {_PAGE_COLS} FROM {ix_sql(PAGE_TABLE)} t ORDER BY slot, id LIMIT 51")
def ix_page_first(spark, sf):
    """G-1: first page with the default limit (50) plus the one-row probe."""
    probe, _ = Q.page_frame(ix_table(spark, sf, PAGE_TABLE), None, None)
    return probe.select(*[c.strip() for c in _PAGE_COLS.split(",")])


@job("ix_page_next",
     f"SELECT {_PAGE_COLS} FROM {ix_sql(PAGE_TABLE)} t "
     f"WHERE slot > {PAGE_CURSOR[0]} OR (slot = {PAGE_CURSOR[0]} AND id > {PAGE_CURSOR[1]}) "
     f"ORDER BY slot, id LIMIT 201")
def ix_page_next(spark, sf):
    """G-1 + C-9: a page after a cursor, at the maximum limit (200) plus the probe."""
    cursor = cursor_encode_py(*PAGE_CURSOR)
    probe, _ = Q.page_frame(ix_table(spark, sf, PAGE_TABLE), 500, cursor)
    return probe.select(*[c.strip() for c in _PAGE_COLS.split(",")])


@job("ix_query_eq",
     f"SELECT {_PAGE_COLS} FROM {ix_sql(PAGE_TABLE)} t WHERE account_user = 'u42' AND arg_userid = '42' "
     f"ORDER BY slot, id LIMIT 51")
def ix_query_eq(spark, sf):
    """C-6: equality filters; the unsafe key is ignored, NULL values are skipped."""
    filters = {"account_user": "u42", "arg_userid": "42", "DROP TABLE--": "x", "arg_amount": None}
    probe, _ = Q.page_frame(ix_table(spark, sf, PAGE_TABLE), None, None, filters)
    return probe.select(*[c.strip() for c in _PAGE_COLS.split(",")])


@job("ix_query_range",
     f"SELECT {_PAGE_COLS} FROM {ix_sql(PAGE_TABLE)} t WHERE slot >= {RANGE_FROM} AND slot <= {RANGE_TO} "
     f"ORDER BY slot, id LIMIT 201")
def ix_query_range(spark, sf):
    """C-5: inclusive slot bounds on an instruction query."""
    probe, _ = Q.page_frame(ix_table(spark, sf, PAGE_TABLE), 200, None,
                            {"slot_from": RANGE_FROM, "slot_to": RANGE_TO})
    return probe.select(*[c.strip() for c in _PAGE_COLS.split(",")])


@job("ix_query_total",
     f"SELECT COUNT(*) AS total FROM {ix_sql(PAGE_TABLE)} t WHERE slot >= {RANGE_FROM} AND account_user = 'u42'")
def ix_query_total(spark, sf):
    """F-12: the filtered total ignores the cursor."""
    return Q.filtered_total(ix_table(spark, sf, PAGE_TABLE), {"slot_from": RANGE_FROM, "account_user": "u42"})


_CURSOR_SQL = f"""
SELECT signature, slot, id,
       rtrim(replace(replace(to_base64(encode('{{"slot":' || CAST(slot AS VARCHAR) || ',"id":'
             || CAST(id AS VARCHAR) || '}}')), '+', '-'), '/', '_'), '=') AS cursor
FROM {ix_sql(PAGE_TABLE)} t"""


@job("cursor_encode", _CURSOR_SQL)
def cursor_encode_job(spark, sf):
    """E-23: the next-page cursor of every row (base64url JSON, no padding)."""
    t = ix_table(spark, sf, PAGE_TABLE)
    return t.select("signature", "slot", "id", cursor_encode(F.col("slot"), F.col("id")).alias("cursor"))


_EV_COLS = "id, event_name, signature, slot, block_time, data"


@job("ev_page", f"SELECT {_EV_COLS} FROM ({EV}) e ORDER BY slot, id LIMIT 51")
def ev_page(spark, sf):
    """G-2: event page, default limit, across event names."""
    probe, _ = Q.page_frame(events(spark, sf), None, None)
    return probe.select(*[c.strip() for c in _EV_COLS.split(",")])


@job("ev_query",
     f"SELECT {_EV_COLS} FROM ({EV}) e WHERE event_name = 'PurchaseMade' AND slot >= {RANGE_FROM} "
     f"AND slot <= {RANGE_TO} ORDER BY slot, id LIMIT 201")
def ev_query(spark, sf):
    """C-7 + C-5: event-name filter and slot range (0 would mean absent)."""
    e = Q.slot_range(events(spark, sf).where(F.col("event_name") == "PurchaseMade"), RANGE_FROM, RANGE_TO,
                     zero_is_absent=True)
    probe, _ = Q.page_frame(e, 200, None)
    return probe.select(*[c.strip() for c in _EV_COLS.split(",")])


@job("ev_payload",
     f"SELECT signature, event_name, json_extract_string(data, '$.amount') AS amount, "
     f"TRY_CAST(json_extract(data, '$.k') AS BIGINT) AS k, json_extract_string(data, '$.memo') AS memo "
     f"FROM ({EV}) e")
def ev_payload(spark, sf):
    """D-8: the JSON payload read back on query."""
    e = events(spark, sf)
    return e.select("signature", "event_name",
                    F.get_json_object("data", "$.amount").alias("amount"),
                    F.get_json_object("data", "$.k").cast("bigint").alias("k"),
                    F.get_json_object("data", "$.memo").alias("memo"))


_RECENT_NAMES = [ix.name for ix in IDL.instructions][:3]
_RECENT_SQL = f"""
SELECT id, ix_name, signature, slot FROM (
  SELECT *, row_number() OVER (PARTITION BY ix_name ORDER BY slot, id) AS rn
  FROM {ix_where("ix_name IN (" + ", ".join(f"'{n}'" for n in _RECENT_NAMES) + ")")} x
) r WHERE rn <= 5 ORDER BY slot DESC, id DESC LIMIT 20"""


@job("recent_activity", _RECENT_SQL)
def recent_activity(spark, sf):
    """G-5: first three types, five rows each from their first page, newest first."""
    names = [ix.name for ix in IDL.instructions]
    return Q.recent_activity(stored(spark, sf, names[:3]), names).select("id", "ix_name", "signature", "slot")


@job("agg_sum_total_decimal",
     f"SELECT SUM(TRY_CAST({AGG_FIELD} AS DECIMAL(38,0))) AS value, COUNT(*) AS total_calls, MIN(slot) AS first_slot, "
     f"MAX(slot) AS last_slot FROM {ix_sql(AGG_TABLE)} t")
def agg_sum_total_decimal(spark, sf):
    """Q-11 option: exact integer sums (decimal) instead of the reference's REAL."""
    return Q.aggregate(ix_table(spark, sf, AGG_TABLE), "total", "sum", AGG_FIELD, numeric_type="decimal")


@job("agg_count_hour_basis",
     f"SELECT COALESCE(block_time // 3600, slot // 9000) AS bucket, "
     f"CASE WHEN block_time IS NULL THEN 'slot' ELSE 'time' END AS basis, COUNT(*) AS value, "
     f"COUNT(*) AS count FROM {ix_sql(AGG_TABLE)} t GROUP BY 1, 2 ORDER BY bucket DESC LIMIT 168")
def agg_count_hour_basis(spark, sf):
    """Q-9 option: buckets derived from block time and from slots are told apart."""
    return Q.aggregate(ix_table(spark, sf, AGG_TABLE), "hour", "count", bucket_basis=True)
