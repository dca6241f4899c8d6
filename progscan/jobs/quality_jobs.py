"""Jobs: checkpoint, gaps, lag, late rows, counters, histogram (B-8, H-2, J-6/7, F-13/14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from progscan.jobs._base import ACT, EV, IDL, IX_ALL, STL, TX, decoded, events, job, raw_accounts, stored, transactions
from progscan.operators import ingest as I
from progscan.operators import quality as Qa
from progscan.operators import store as S
from progscan.operators.ingest import decode_accounts
from progscan.sources import derived as D
from progscan.streaming import seen_slots

SEEN_BUCKET = 4096


def _settlements(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    s = D.settlement_columns(li)
    return s.select("signature", "slot", "block_time", (F.col("l_returnflag") != "R").alias("ok"))


@job("checkpoint_max", f"SELECT GREATEST(COALESCE(MAX(slot), 0), 0) AS last_processed_slot FROM ({TX}) t WHERE ok")
def checkpoint_max(spark, sf):
    """B-8: ``last_processed_slot`` = max slot of the processed (ok) transactions, from 0."""
    ok = I.ok_transactions(transactions(spark, sf))
    return S.checkpoint_max(ok, previous=0)


@job("gap_by_slot",
     f"SELECT signature, slot FROM ({STL}) s WHERE slot NOT IN "
     f"(SELECT slot FROM ({STL}) p WHERE l_returnflag <> 'R')")
def gap_by_slot(spark, sf):
    """H-2 / J-5: listed transactions whose *slot* was never processed (reference rule)."""
    listing = D.signature_listing(spark, sf)
    processed = _settlements(spark, sf).where("ok")
    return Qa.gaps(listing, processed, on="slot").select("signature", "slot")


@job("gap_by_interval",
     f"SELECT signature, slot FROM ({STL}) s WHERE slot NOT IN "
     f"(SELECT slot FROM ({STL}) p WHERE l_returnflag <> 'R')")
def gap_by_interval(spark, sf):
    """H-2 / J-5: as gap_by_slot, with the seen slots kept as merged intervals (a range anti-join by carry)."""
    seen = seen_slots.of_slots(_settlements(spark, sf).where("ok"), SEEN_BUCKET)
    return seen_slots.gaps(D.signature_listing(spark, sf), seen, SEEN_BUCKET).select("signature", "slot")


@job("gap_by_signature",
     f"SELECT signature, slot FROM ({STL}) s WHERE signature NOT IN "
     f"(SELECT signature FROM ({STL}) p WHERE l_returnflag <> 'R')")
def gap_by_signature(spark, sf):
    """H-2 option: listed transactions never processed, by signature (no same-slot hole)."""
    listing = D.signature_listing(spark, sf)
    processed = _settlements(spark, sf).where("ok")
    return Qa.gaps(listing, processed, on="signature").select("signature", "slot")


@job("slot_lag", f"""
SELECT c.chain_slot, p.last_processed_slot,
       CASE WHEN c.chain_slot > 0 AND p.last_processed_slot > 0 THEN c.chain_slot - p.last_processed_slot END
         AS slot_lag
FROM (SELECT MAX(slot) AS chain_slot FROM ({STL}) s) c,
     (SELECT MAX(slot) AS last_processed_slot FROM ({STL}) s WHERE l_returnflag <> 'R') p""")
def slot_lag(spark, sf):
    """J-7: chain tip (listing) minus the last processed slot."""
    listing = D.signature_listing(spark, sf)
    processed = _settlements(spark, sf).where("ok")
    return Qa.slot_lag(listing, processed)


@job("late_rows", f"""
WITH s AS (SELECT signature, slot, block_time // 86400 AS batch_day, l_returnflag <> 'R' AS ok FROM ({STL}) x),
per AS (SELECT batch_day, MAX(CASE WHEN ok THEN slot END) AS m FROM s GROUP BY batch_day),
ck AS (SELECT batch_day, MAX(m) OVER (ORDER BY batch_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              AS checkpoint FROM per)
SELECT s.signature, s.slot, s.batch_day, ck.checkpoint FROM s JOIN ck USING (batch_day)
WHERE s.slot <= ck.checkpoint""")
def late_rows(spark, sf):
    """J-6: settlements arriving by ship day; rows at or below the checkpoint left by
    earlier days would be skipped by the listing paths (A-4/A-5)."""
    rows = _settlements(spark, sf).withColumn("batch_day", F.floor(F.col("block_time") / 86400).cast("bigint"))
    return Qa.late_rows(rows, "batch_day").select("signature", "slot", "batch_day", "checkpoint")


_COUNTERS_SQL = f"""
SELECT 'indexer_transactions_total' AS metric, '{IDL.name}:' || CASE WHEN ok THEN 'ok' ELSE 'skipped' END AS label,
       COUNT(*) AS value FROM ({TX}) t GROUP BY 2
UNION ALL
SELECT 'indexer_events_decoded_total', event_name, COUNT(*) FROM ({EV}) e GROUP BY 2
UNION ALL
SELECT 'indexer_instructions_indexed_total', ix_name, COUNT(*) FROM (
  SELECT event_type AS ix_name FROM ({ACT}) a WHERE event_type <> 'error'
  UNION ALL SELECT 'settle' FROM ({STL}) s WHERE l_returnflag <> 'R'
  UNION ALL SELECT 'settle' FROM ({STL}) s WHERE l_returnflag <> 'R') i GROUP BY 2
UNION ALL
SELECT 'indexer_accounts_synced_total', 'Customer', COUNT(*) FROM customer
UNION ALL
SELECT 'indexer_accounts_synced_total', 'Supplier', COUNT(*) FROM supplier"""


@job("metric_counters", _COUNTERS_SQL)
def metric_counters(spark, sf):
    """F-13: labelled counters -- transactions by status, events and instructions by name
    (decoded, Q-15), accounts by type."""
    tx = transactions(spark, sf).select(
        F.concat(F.lit(IDL.name + ":"), F.when(F.col("meta").isNotNull() & F.col("meta.err").isNull(), "ok")
                 .otherwise("skipped")).alias("status"))
    parts = [
        Qa.labelled_counts(tx, "indexer_transactions_total", "status"),
        Qa.labelled_counts(events(spark, sf), "indexer_events_decoded_total", "event_name"),
        Qa.labelled_counts(decoded(spark, sf), "indexer_instructions_indexed_total", "ix_name"),
        Qa.labelled_counts(decode_accounts(raw_accounts(spark, sf), IDL), "indexer_accounts_synced_total",
                           "account_type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@job("metric_stored", f"""
SELECT 'indexer_instructions_indexed_total' AS metric, ix_name AS label, COUNT(*) AS value FROM (
  SELECT event_type AS ix_name FROM ({ACT}) a WHERE event_type <> 'error'
  UNION ALL SELECT 'settle' FROM ({STL}) s WHERE l_returnflag <> 'R'
  UNION ALL SELECT 'settle' FROM ({STL}) s WHERE l_returnflag <> 'R') i GROUP BY 2
UNION ALL
SELECT 'indexer_instructions_stored_total', ix_name, COUNT(*) FROM {IX_ALL} x GROUP BY 2""")
def metric_stored(spark, sf):
    """F-13 + Q-15: instructions by name, decoded (what the reference counts) beside stored (after insert-ignore)."""
    return Qa.labelled_counts(decoded(spark, sf), "indexer_instructions_indexed_total", "ix_name").unionByName(
        Qa.labelled_counts(stored(spark, sf), "indexer_instructions_stored_total", "ix_name"))


def _hist_sql() -> str:
    parts = [f"SELECT 'bucket' AS series, '{Qa._fmt(b)}' AS le, CAST(count_if(value <= {b}) AS DOUBLE) AS value "
             f"FROM events" for b in Qa.TX_LATENCY_BOUNDS_MS]
    parts.append("SELECT 'bucket', '+Inf', CAST(COUNT(value) AS DOUBLE) FROM events")
    parts.append("SELECT 'sum', NULL, CAST(SUM(CAST(value AS DECIMAL(38,6))) AS DOUBLE) FROM events")
    parts.append("SELECT 'count', NULL, CAST(COUNT(value) AS DOUBLE) FROM events")
    return "\nUNION ALL\n".join(parts)


@job("metric_histogram", _hist_sql())
def metric_histogram(spark, sf):
    """F-14: cumulative histogram (bounds of the tx-latency metric) over event values."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return Qa.histogram(e, "value", Qa.TX_LATENCY_BOUNDS_MS)
