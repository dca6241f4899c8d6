"""Jobs: account scans, decode, snapshot, history, point-in-time, changes (A-7..9, B-4..6, L-1/2/5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from progscan.jobs._base import ACT, IDL, account_updates, job, raw_accounts, sql_disc, sql_le_hex
from progscan.operators import accounts as A
from progscan.operators import query as Q
from progscan.operators import store as S
from progscan.operators.ingest import decode_accounts
from progscan.session import scratch_dir
from progscan.sources.staging import staged
from progscan.streaming import pipelines as P

_CUST_COLS = ["pubkey", "slot", "custkey", "nationkey", "balance", "segment"]

_CUST_SQL = """
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS pubkey, c_custkey AS slot, CAST(c_custkey AS VARCHAR) AS custkey,
       CAST(c_nationkey AS VARCHAR) AS nationkey, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS balance,
       c_mktsegment AS segment
FROM customer"""

_ACC_JSON_SQL = """
SELECT 'Customer' AS account_type, 'c' || CAST(c_custkey AS VARCHAR) AS pubkey, c_custkey AS slot,
       '{"custkey":"' || CAST(c_custkey AS VARCHAR) || '","nationkey":' || CAST(c_nationkey AS VARCHAR)
       || ',"balance":"' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) || '","segment":"'
       || c_mktsegment || '"}' AS data
FROM customer
UNION ALL
SELECT 'Supplier', 's' || CAST(s_suppkey AS VARCHAR), s_suppkey,
       '{"suppkey":"' || CAST(s_suppkey AS VARCHAR) || '","nationkey":' || CAST(s_nationkey AS VARCHAR)
       || ',"balance":"' || CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR) || '"}'
FROM supplier"""

# decoded history rows: every event rewrites customer account c<user_id>
_HIST_SQL = f"""
SELECT 'c' || CAST(user_id AS VARCHAR) AS pubkey, slot, CAST(user_id AS VARCHAR) AS custkey,
       CAST(k AS VARCHAR) AS nationkey, CAST(amount AS VARCHAR) AS balance, event_type AS segment
FROM ({ACT}) a"""

AS_OF_SLOT = 5000
HISTORY_KEY, HISTORY_LIMIT, HISTORY_OFFSET = "c42", 20, 5
RETENTION_BUCKET, RETENTION_FROM = 1000, 6500


def decode_history(spark, sf):
    """B-6 / A-10: decode account-change observations (the append step)."""
    h = decode_accounts(account_updates(spark, sf), IDL, ["Customer"])
    return h.select("pubkey", "slot", "seq", "custkey", "nationkey", "balance", "segment")


def history(spark, sf):
    """The stored (append-only) history table, sorted by (slot, seq)."""
    return staged(spark, sf, "acc_history", lambda: decode_history(spark, sf), sort_by=["slot", "seq"])


@job("acc_scan_type", _CUST_SQL)
def acc_scan_type(spark, sf):
    """A-7 + E-22: accounts of one type by 8-byte prefix, decoded."""
    acc = A.scan_type(raw_accounts(spark, sf), "Customer")
    d = decode_accounts(acc, IDL, ["Customer"])
    return d.select(*_CUST_COLS)


@job("acc_sweep",
     "SELECT 'Customer' AS account_type, COUNT(*) AS n_accounts FROM customer "
     "UNION ALL SELECT 'Supplier', COUNT(*) FROM supplier")
def acc_sweep(spark, sf):
    """A-8 / J-8: all types in one scan; unknown prefixes and short data are skipped."""
    return A.sweep(raw_accounts(spark, sf), IDL)


@job("acc_decode", _ACC_JSON_SQL)
def acc_decode(spark, sf):
    """E-22: every account decoded with its type's fields, as JSON text."""
    d = decode_accounts(raw_accounts(spark, sf), IDL)
    return d.select("account_type", "pubkey", "slot", "data")


@job("acc_decode_unknown", f"""
SELECT * FROM ({_ACC_JSON_SQL}) a
UNION ALL
SELECT NULL, 'p' || CAST(p_partkey AS VARCHAR), p_partkey,
       '{{"raw_hex":"' || {sql_disc('account:', "'Part'")} || lower({sql_le_hex('p_size', 4)}) || '"}}' FROM part""")
def acc_decode_unknown(spark, sf):
    """E-22: accounts of a type that the IDL does not know keep their bytes, as hex."""
    return decode_accounts(raw_accounts(spark, sf), IDL, unknown=True).select("account_type", "pubkey", "slot", "data")


@job("acc_reindex", f"SELECT account_type, pubkey, CAST(0 AS BIGINT) AS slot, data FROM ({_ACC_JSON_SQL}) a")
def acc_reindex(spark, sf):
    """A-9: full re-index written as snapshot rows at slot 0 (matched by discriminator)."""
    return A.reindex(raw_accounts(spark, sf), IDL)


@job("acc_history", _HIST_SQL)
def acc_history(spark, sf):
    """B-6: every observation appended, unchanged ones included."""
    return decode_history(spark, sf).select(*_CUST_COLS)


_SNAP_SQL = f"""
SELECT pubkey, slot, custkey, nationkey, balance, segment FROM (
  SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC) AS rn FROM ({_HIST_SQL}) h
) x WHERE rn = 1"""


@job("acc_snapshot", _SNAP_SQL)
def acc_snapshot(spark, sf):
    """B-4: one row per pubkey, the last observation (slot, then arrival)."""
    return A.snapshot(history(spark, sf)).select(*_CUST_COLS)


@job("acc_as_of", _SNAP_SQL.replace(f"FROM ({_HIST_SQL}) h", f"FROM ({_HIST_SQL}) h WHERE slot <= {AS_OF_SLOT}"))
def acc_as_of(spark, sf):
    """L-1: state of every account as of a slot."""
    return A.as_of(history(spark, sf), AS_OF_SLOT).select(*_CUST_COLS)


@job("acc_history_page",
     f"SELECT * FROM ({_HIST_SQL}) h WHERE pubkey = '{HISTORY_KEY}' ORDER BY slot DESC "
     f"LIMIT {HISTORY_LIMIT} OFFSET {HISTORY_OFFSET}")
def acc_history_page(spark, sf):
    """G-3 + C-8: one account's history, newest first, limit and offset."""
    h = history(spark, sf).withColumnRenamed("seq", "id")
    return Q.history_page(h, HISTORY_KEY, HISTORY_LIMIT, HISTORY_OFFSET).select(*_CUST_COLS)


@job("acc_changes", f"""
SELECT pubkey, slot, custkey, nationkey, balance, segment FROM (
  SELECT *, lag(segment) OVER (PARTITION BY pubkey ORDER BY slot) AS prev,
            row_number() OVER (PARTITION BY pubkey ORDER BY slot) AS rn
  FROM ({_HIST_SQL}) h
) x WHERE rn = 1 OR prev IS DISTINCT FROM segment""")
def acc_changes(spark, sf):
    """L-2: observations where the account's segment changed (first one included).

    The lag runs inside (pubkey, slot bucket) windows; a small bucket summary
    carries the last value across bucket edges, so a hot account is split."""
    return A.changes(history(spark, sf), ["segment"], bucket_slots=RETENTION_BUCKET).select(*_CUST_COLS)


@job("acc_retention", f"SELECT * FROM ({_HIST_SQL}) h WHERE slot // {RETENTION_BUCKET} >= "
                      f"{RETENTION_FROM // RETENTION_BUCKET}")
def acc_retention(spark, sf):
    """L-5: history retention by whole slot buckets."""
    return A.retention(history(spark, sf), RETENTION_FROM, RETENTION_BUCKET).select(*_CUST_COLS)


@job("acc_merge_pg", f"""
SELECT pubkey, MAX(slot) AS slot,
       arg_max(custkey, slot) FILTER (WHERE custkey IS NOT NULL) AS custkey,
       arg_max(nationkey, slot) FILTER (WHERE nationkey IS NOT NULL) AS nationkey,
       arg_max(balance, slot) FILTER (WHERE balance IS NOT NULL) AS balance,
       arg_max(segment, slot) FILTER (WHERE segment IS NOT NULL) AS segment
FROM (SELECT pubkey, slot, custkey, nationkey, balance,
             CASE WHEN segment = 'view' THEN NULL ELSE segment END AS segment FROM ({_HIST_SQL}) h) x
GROUP BY pubkey""")
def acc_merge_pg(spark, sf):
    """B-5 (Postgres variant): a field absent from an observation keeps its previous value.
    Here ``view`` observations carry no segment."""
    h = history(spark, sf).withColumn("segment", F.when(F.col("segment") == "view", F.lit(None))
                                      .otherwise(F.col("segment")))
    m = S.merge_present(h, ["pubkey"], ["slot", "seq"], ["custkey", "nationkey", "balance", "segment"])
    return m.select(*_CUST_COLS)


SWEEP_SLOT = 1_000_000_000


@job("acc_snapshot_incremental", _SNAP_SQL)
def acc_snapshot_incremental(spark, sf):
    """B-4 kept up to date: the changes arrive in four batches, each adding to the snapshot's buckets that it touches;
    buckets are merged on the way. Equal to the snapshot recomputed from all history."""
    sink = scratch_dir(spark, "snapshot")
    updates = account_updates(spark, sf)
    for n in range(4):
        hist = decode_accounts(updates.where(F.col("slot") % 4 == n), IDL, ["Customer"]).drop("data")
        P.account_snapshot(spark, sink, 8).apply(hist, n, compact_after=2)
    return P.account_snapshot(spark, sink, 8).read().select(*_CUST_COLS)


_SWEPT_SQL = f"""
SELECT account_type, pubkey, CAST({SWEEP_SLOT} AS BIGINT) AS slot, custkey, suppkey, nationkey, balance, segment FROM (
  SELECT 'Customer' AS account_type, pubkey, custkey, CAST(NULL AS VARCHAR) AS suppkey, nationkey, balance, segment
  FROM ({_CUST_SQL}) c
  UNION ALL
  SELECT 'Supplier', 's' || CAST(s_suppkey AS VARCHAR), NULL, CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR),
         CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR), NULL FROM supplier) d"""
_UPDATES_SQL = f"""
SELECT 'Customer' AS account_type, pubkey, slot, custkey, CAST(NULL AS VARCHAR) AS suppkey, nationkey, balance, segment
FROM ({_HIST_SQL}) h"""


@job("acc_resync", f"""
SELECT 'history' AS kept_in, * FROM ({_UPDATES_SQL}) u UNION ALL SELECT 'history', * FROM ({_SWEPT_SQL}) s
UNION ALL
SELECT 'snapshot', * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY account_type, pubkey ORDER BY slot DESC) AS rn
  FROM (SELECT * FROM ({_UPDATES_SQL}) u UNION ALL SELECT * FROM ({_SWEPT_SQL}) s) b) x WHERE rn = 1""")
def acc_resync(spark, sf):
    """J-8 + A-8: account changes, then a sweep of the whole dump: both write history and snapshot, the sweep at its
    slot; accounts that the dump lacks keep their last state."""
    sink = scratch_dir(spark, "resync")
    P.process_accounts(account_updates(spark, sf), 0, sink, IDL, 8)
    P.resync_accounts(raw_accounts(spark, sf), SWEEP_SLOT, 1, sink, IDL, 8)
    cols = ["account_type", "pubkey", "slot", "custkey", "suppkey", "nationkey", "balance", "segment"]
    history_rows = P.read_stored(spark, sink, "history").select(F.lit("history").alias("kept_in"), *cols)
    return history_rows.unionByName(P.account_snapshot(spark, sink, 8).read().select(F.lit("snapshot").alias("kept_in"), *cols))


@job("acc_history_lookup", f"SELECT * FROM ({_HIST_SQL}) h WHERE pubkey = '{HISTORY_KEY}' ORDER BY slot DESC "
                           f"LIMIT {HISTORY_LIMIT} OFFSET {HISTORY_OFFSET}")
def acc_history_lookup(spark, sf):
    """G-3 + C-8 on history laid out by account: the page reads its bucket's folder, and there the row groups whose
    statistics and Bloom filter may hold the account."""
    path = scratch_dir(spark, "history_by_key")
    S.write_history(history(spark, sf), path)
    h = S.history_of(spark.read.parquet(path), HISTORY_KEY).withColumnRenamed("seq", "id")
    return Q.history_page(h, HISTORY_KEY, HISTORY_LIMIT, HISTORY_OFFSET).select(*_CUST_COLS)
