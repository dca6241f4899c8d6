"""Jobs: streaming ingest, dedup, backfill-then-stream, gap check, account stream
(J-1..J-5, A-6, A-10).

Each job writes the derived input as several files into a fresh folder under
the shared checkpoint dir, drains it with ``trigger(availableNow=True)`` and
``FILES_PER_TRIGGER`` files per micro-batch, and returns the sink read back as
a batch frame.
All copies of a signature live in one file (the input is partitioned by
slot), so "first wins" is the same whether decided in one batch or many.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from progscan.jobs._base import (
    IDL, IX_ACT, IX_ALL, PID, TX, account_updates, activity_transactions, ix_sql, job, transactions,
)
from progscan.jobs.account_jobs import _CUST_COLS, _SNAP_SQL
from progscan.operators import accounts as A
from progscan.plans.idl import Idl
from progscan.session import dropped_shuffles, scratch_dir
from progscan.sources import derived as D
from progscan.sources.staging import _fs
from progscan.streaming import pipelines as P
from progscan.streaming.rollups import Rollups

FILES = 6
FILES_PER_TRIGGER = 2
SOURCE_BYTES = 4 << 20
BACKFILL_BELOW = 5000
_COLS = ["ix_name", "id", "signature", "slot", "block_time", "cpi_depth", "parent_ix_index", "account_user",
         "account_authority", "account_order", "account_supplier", "arg_amount", "arg_k", "arg_userid",
         "arg_quantity", "arg_price", "arg_discount"]


def _per_file(spark, sf):
    """Files that stand for one of FILES: as many as keep each one's share of the input at SOURCE_BYTES."""
    size = 0
    for name in ("events", "lineitem"):
        path, fs = _fs(spark, f"{sf.rstrip('/')}/{name}.parquet")
        size += fs.getContentSummary(path).getLength()
    return max(1, math.ceil(size / FILES / SOURCE_BYTES))


def _write_source(spark, sf, src, mode="overwrite", only="true"):
    """Transactions as files of whole slots. The narrow source rows are shuffled, not the records made of them."""
    transactions(spark, sf, FILES * _per_file(spark, sf)).where(only).write.mode(mode).option("compression", "zstd").parquet(src)


def _replay(spark, src):
    """Replayed copies: the files of a source once more, in the order they were written in. Bytes are copied, no record is
    built or encoded again."""
    path, fs = _fs(spark, src)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    parts = [f for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")]
    for f in sorted(parts, key=lambda f: (f.getModificationTime(), f.getPath().getName())):
        copy = hadoop.Path(path, f"replay-{f.getPath().getName()}")
        if not hadoop.FileUtil.copy(fs, f.getPath(), fs, copy, False, conf):
            raise OSError(f"cannot write {copy}")


def _fetch(spark, sf):
    """All transactions as an archive: it looks for the missing ones among its narrow source rows, between the first and the
    last of their slots, and builds the records of these."""
    def fetch(missing):
        first, last = missing.agg(F.min("slot"), F.max("slot")).first()
        return transactions(spark, sf, signatures=missing).where(F.col("slot").between(F.lit(first), F.lit(last)))

    return fetch


def _run_tx_stream(spark, sf, base, backfill=None):
    src = f"{base}/source"
    sink = f"{base}/sink"
    with dropped_shuffles(spark):
        _write_source(spark, sf, src)
        if backfill is not None:
            P.backfill(backfill, sink, IDL, PID)
        q = P.start_transactions(spark, src, sink, f"{base}/offsets", IDL, PID,
                                 files_per_trigger=FILES_PER_TRIGGER * _per_file(spark, sf))
        q.awaitTermination()
    return P.read_stored(spark, sink).select(*_COLS)


@job("stream_ingest", f"SELECT * FROM {IX_ALL} x")
def stream_ingest(spark, sf):
    """J-1 / A-6: transactions streamed in micro-batches end in the same stored tables."""
    return _run_tx_stream(spark, sf, scratch_dir(spark, "stream_ingest"))


@job("stream_dedup", f"SELECT * FROM {IX_ALL} x")
def stream_dedup(spark, sf):
    """J-4: unbounded signature dedup across micro-batches -- the whole input arrives twice."""
    base = scratch_dir(spark, "stream_dedup")
    src = f"{base}/source"
    sink = f"{base}/sink"
    with dropped_shuffles(spark):
        _write_source(spark, sf, src)
        _replay(spark, src)
        q = P.start_transactions(spark, src, sink, f"{base}/offsets", IDL, PID,
                                 files_per_trigger=2 * FILES_PER_TRIGGER * _per_file(spark, sf))
        q.awaitTermination()
    return P.read_stored(spark, sink).select(*_COLS)


@job("stream_dedup_compacted", f"SELECT * FROM ({IX_ACT}) x")
def stream_dedup_compacted(spark, sf):
    """J-4 + B-1: four batches of which each repeats part of the one before, with the runs of the key index merged
    after every second batch; the last batch finds its copies in merged runs."""
    base = scratch_dir(spark, "stream_compacted")
    tx = activity_transactions(spark, sf)
    for n in range(4):
        # a fifth of the slots stands in every batch, each other slot in one batch and the next
        part = tx.where((F.col("slot") % 5 == 0) | (F.col("slot") % 4).isin(n, (n + 1) % 4))
        P.process_transactions(part, n, f"{base}/sink", IDL, PID, fanout=2)
    return P.read_stored(spark, f"{base}/sink").select(*_COLS)


DROPPED = "slot % 5 = 0"


@job("stream_gap_fill", f"SELECT * FROM {IX_ALL} x")
def stream_gap_fill(spark, sf):
    """H-2 / J-1: a stream whose source lacks a fifth of the slots; after each micro-batch what the listing has and
    the stream has not is fetched from the archive. The end is the full ingest, and a replayed fill adds nothing."""
    base = scratch_dir(spark, "stream_gap_fill")
    tx = transactions(spark, sf)
    src, sink, listing = f"{base}/source", f"{base}/sink", f"{base}/listing"
    archive = _fetch(spark, sf)
    with dropped_shuffles(spark):
        for n, part in enumerate((f"slot < {BACKFILL_BELOW}", f"slot >= {BACKFILL_BELOW}")):
            _write_source(spark, sf, src, "append", f"{part} AND NOT ({DROPPED})")
            tx.where(part).select("signature", "slot").write.mode("append").option("compression", "zstd").parquet(listing)
            q = P.start_transactions(spark, src, sink, f"{base}/offsets", IDL, PID,
                                     files_per_trigger=FILES * _per_file(spark, sf), listing=listing,
                                     gap_every=1, gap_requires_progress=False, archive=archive)
            q.awaitTermination()
        P.fill_gaps(spark, n, sink, IDL, PID, archive)
    return P.read_stored(spark, sink).select(*_COLS)


_LATE_HALF = "slot % 3 = 1"


@job("stream_late", f"""
SELECT ix_name, signature, slot FROM {IX_ALL} x
WHERE {_LATE_HALF} AND slot <= (SELECT MAX(slot) FROM ({TX}) t WHERE ok AND NOT ({_LATE_HALF}))""")
def stream_late(spark, sf):
    """J-6: a third of the slots arrives in a second batch; its rows at or below the first one's checkpoint are
    stored with the late flag."""
    sink = f"{scratch_dir(spark, 'stream_late')}/sink"
    tx = transactions(spark, sf)
    P.process_transactions(tx.where(f"NOT ({_LATE_HALF})"), 0, sink, IDL, PID)
    P.process_transactions(tx.where(_LATE_HALF), 1, sink, IDL, PID)
    return P.read_stored(spark, sink).where("late").select("ix_name", "signature", "slot")


OLD_BELOW = 5000
_OLD_IDL = Idl.from_dict({**D.ACTIVITY_IDL_DOC, "version": "0.0.9", "instructions": [
    {**ix, "args": [a for a in ix["args"] if a["name"] != "userId"]} for ix in D.ACTIVITY_IDL_DOC["instructions"]]})


@job("ix_evolved_read", f"""
SELECT * REPLACE (CASE WHEN slot >= {OLD_BELOW} THEN arg_userid END AS arg_userid) FROM ({IX_ACT}) x""")
def ix_evolved_read(spark, sf):
    """I-5: one batch stored under an IDL without the argument userId, one under the IDL with it: the table reads
    with the columns of both, from its schema manifest; older rows have no value."""
    sink = f"{scratch_dir(spark, 'evolved')}/sink"
    tx = activity_transactions(spark, sf)
    P.process_transactions(tx.where(F.col("slot") < OLD_BELOW), 0, sink, _OLD_IDL, PID)
    P.process_transactions(tx.where(F.col("slot") >= OLD_BELOW), 1, sink, IDL, PID)
    return P.read_stored(spark, sink).select(*_COLS)


@job("stream_after_backfill", f"SELECT * FROM {IX_ALL} x")
def stream_after_backfill(spark, sf):
    """J-3: batch backfill of the older slots, then the stream over everything on the same sink."""
    tx = transactions(spark, sf)
    return _run_tx_stream(spark, sf, scratch_dir(spark, "stream_backfill"),
                          backfill=tx.where(F.col("slot") < BACKFILL_BELOW))


@job("stream_accounts", _SNAP_SQL)
def stream_accounts(spark, sf):
    """A-10: account changes streamed into history; the snapshot is derived from it."""
    base = scratch_dir(spark, "stream_accounts")
    src = f"{base}/source"
    account_updates(spark, sf).repartition(FILES, "slot").write.mode("overwrite").parquet(src)
    sink = f"{base}/sink"
    q = P.start_accounts(spark, src, sink, f"{base}/offsets", IDL, files_per_trigger=FILES_PER_TRIGGER)
    q.awaitTermination()
    hist = P.read_stored(spark, sink, "history")
    return A.snapshot(hist).select(*_CUST_COLS)


@job("stream_gap_check", f"""
SELECT signature, slot FROM ({TX}) t WHERE slot NOT IN (SELECT slot FROM ({TX}) s WHERE ok)""")
def stream_gap_check(spark, sf):
    """J-1 + H-2 + J-5: the realtime loop's gap check, run inside the micro-batches against
    the seen-slot table; the result after the last batch (listing = every transaction)."""
    base = scratch_dir(spark, "stream_gaps")
    tx = transactions(spark, sf)
    src = f"{base}/source"
    sink = f"{base}/sink"
    listing = tx.select("signature", "slot")
    with dropped_shuffles(spark):
        _write_source(spark, sf, src)
        q = P.start_transactions(spark, src, sink, f"{base}/offsets", IDL, PID,
                                 files_per_trigger=FILES_PER_TRIGGER * _per_file(spark, sf), listing=listing,
                                 gap_every=1, gap_requires_progress=False)
        q.awaitTermination()
    gaps = spark.read.parquet(f"{sink}/gaps")
    last = gaps.agg(F.max("batch_id")).first()[0]
    return gaps.where(F.col("batch_id") == last).select("signature", "slot")


_ROLLED = "purchase"


def _rolled_sql(group_by: str) -> str:
    src, value = ix_sql(_ROLLED), "TRY_CAST(arg_amount AS DOUBLE)"
    values = f"SUM({value}) AS sum, AVG({value}) AS avg, MIN({value}) AS min, MAX({value}) AS max, COUNT(*) AS count"
    if group_by == "total":
        return f"SELECT {values}, MIN(slot) AS first_slot, MAX(slot) AS last_slot FROM {src} t"
    secs, slots, lim = (3600, 9000, 168) if group_by == "hour" else (86400, 216000, 30)
    return (f"SELECT COALESCE(block_time // {secs}, slot // {slots}) AS bucket, {values} FROM {src} t "
            f"GROUP BY 1 ORDER BY bucket DESC LIMIT {lim}")


def _rolled(spark, sf, group_by: str):
    """The four values of one field side by side, from states that two batches left; no instruction row is read."""
    sink = f"{scratch_dir(spark, 'rollups')}/sink"
    tx = activity_transactions(spark, sf)
    P.process_transactions(tx.where("slot % 2 = 0"), 0, sink, IDL, PID, rollups=True)
    P.process_transactions(tx, 1, sink, IDL, PID, rollups=True)
    r = Rollups(spark, f"{sink}/rollups")
    keys = ["bucket"] if group_by != "total" else ["first_slot", "last_slot"]
    out = r.aggregate(_ROLLED, group_by, "count").select(*keys, F.col("value").alias("count"))
    for op in ("sum", "avg", "min", "max"):
        part = r.aggregate(_ROLLED, group_by, op, "arg_amount").select(*keys, F.col("value").alias(op))
        out = out.join(part, keys)
    return out


@job("rollup_hour", _rolled_sql("hour"))
def rollup_hour(spark, sf):
    """F-1..F-7, G-4 from maintained states: the newest hours."""
    return _rolled(spark, sf, "hour")


@job("rollup_day", _rolled_sql("day"))
def rollup_day(spark, sf):
    """F-2, F-4..F-7 from maintained states: the newest days."""
    return _rolled(spark, sf, "day")


@job("rollup_total", _rolled_sql("total"))
def rollup_total(spark, sf):
    """F-3..F-7 from maintained states: all rows of the type."""
    return _rolled(spark, sf, "total")
