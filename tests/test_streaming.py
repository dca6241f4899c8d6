"""Streaming = batch; replaying a micro-batch is idempotent; per-batch counters."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from progscan.jobs import _base as B
from progscan.sources import transactions as X
from progscan.streaming import pipelines as P
from progscan.streaming import seen_slots
from progscan.streaming.bucket_store import BucketStore
from progscan.streaming.key_index import KeyIndex
from progscan.streaming.seen_slots import SeenSlots


def _stored_rows(df):
    return sorted(tuple(r) for r in df.select("ix_name", "signature", "slot", "id", "arg_amount", "arg_price").collect())


def test_replayed_batch_is_idempotent(spark, sf_small):
    tx = B.transactions(spark, sf_small)
    sink = tempfile.mkdtemp(prefix="sink-", dir="/tmp")
    P.process_transactions(tx.where("slot < 500"), 0, sink, B.IDL, B.PID)
    P.process_transactions(tx, 1, sink, B.IDL, B.PID)
    first = _stored_rows(P.read_stored(spark, sink))
    P.process_transactions(tx, 1, sink, B.IDL, B.PID)  # the same batch again (restart)
    again = _stored_rows(P.read_stored(spark, sink))
    assert first == again
    assert first == _stored_rows(B.ingest_instructions(spark, sf_small))
    state = spark.read.parquet(f"{sink}/state").orderBy("batch_id").collect()
    assert state[-1]["instructions_stored"] + state[0]["instructions_stored"] == len(first)
    assert state[-1]["last_processed_slot"] > 0 and state[-1]["tx_skipped"] > 0


def test_stream_equals_batch(spark, sf_small):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    tx = B.transactions(spark, sf_small)
    tx.repartition(3, "slot").write.parquet(f"{base}/src")
    q = P.start_transactions(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", B.IDL, B.PID, files_per_trigger=1)
    q.awaitTermination()
    assert _stored_rows(P.read_stored(spark, f"{base}/sink")) == _stored_rows(B.ingest_instructions(spark, sf_small))


def test_partitioned_transactions_prune_by_slot_bucket(spark, sf_small):
    base = tempfile.mkdtemp(prefix="txp-", dir="/tmp")
    X.write_transactions(B.transactions(spark, sf_small), f"{base}/tx")
    t = spark.read.parquet(f"{base}/tx")
    q = X.slot_range(t, 100, 200)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "slot_bucket" in plan
    assert q.count() == B.transactions(spark, sf_small).where(F.col("slot").between(100, 200)).count()


def test_periodic_gap_check_and_lag(spark, sf_small):
    from progscan.operators import quality as Qa

    base = tempfile.mkdtemp(prefix="gapck-", dir="/tmp")
    tx = B.transactions(spark, sf_small)
    tx.repartition(4, "slot").write.parquet(f"{base}/src")
    listing = tx.select("signature", "slot")
    q = P.start_transactions(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", B.IDL, B.PID,
                             files_per_trigger=1, listing=listing, gap_every=3, gap_requires_progress=False)
    q.awaitTermination()
    gaps = spark.read.parquet(f"{base}/sink/gaps")
    batches = sorted(r[0] for r in gaps.select("batch_id").distinct().collect())
    assert batches and all(b % 3 == 0 for b in batches)
    # the last check equals the batch gap job over what was stored by then
    last = batches[-1]
    files = spark.read.parquet(f"{base}/src").select("slot", "meta", F.input_file_name().alias("f"))
    seen = SeenSlots(spark, f"{base}/sink/seen_slots").read(P.sequence(last) + 1)
    seen = seen.select(F.explode(F.sequence("lo", "hi")).alias("slot"))
    assert seen.join(files.where("meta.err IS NULL"), "slot", "left_anti").count() == 0
    want = Qa.gaps(listing, seen, on="slot")
    assert want.count() > 0  # failed transactions are never seen
    got = gaps.where(F.col("batch_id") == last).select("signature", "slot")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("signature", "slot").collect()))
    lag = spark.read.parquet(f"{base}/sink/lag").collect()
    assert all(r["slot_lag"] is None or r["slot_lag"] >= 0 for r in lag)


def test_bounded_dedup_within_watermark(spark, sf_small):
    base = tempfile.mkdtemp(prefix="wm-", dir="/tmp")
    tx = B.activity_transactions(spark, sf_small)
    tx.repartition(2, "slot").write.parquet(f"{base}/src")
    tx.repartition(2, "slot").write.mode("append").parquet(f"{base}/src")  # every transaction twice
    src = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/src")
    out = P.dedup_within_watermark(src, "1 hour").select("signature")
    q = (out.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    assert got.count() == got.distinct().count() == tx.count()


def _keys(spark, n, per=40):
    return spark.createDataFrame([("ix", f"s{n}-{i}") for i in range(per)], "ix_name string, signature string")


def test_key_index_finds_all_and_opens_few_files(spark):
    """The files that a batch opens follow the levels of the index, not the number of past batches."""
    root = tempfile.mkdtemp(prefix="keys-", dir="/tmp")
    index, opened = KeyIndex(spark, root, fanout=3), {}
    for n in range(19):
        index.add(_keys(spark, n), n)
        if n in (8, 13, 17):  # runs of one level only, then of more
            probe = spark.createDataFrame([("ix", "s3-7"), ("ix", "new")], "ix_name string, signature string")
            found = index.lookup(probe, n + 1)
            opened[n] = found.select(F.input_file_name().alias("f")).distinct().count()
    assert max(opened.values()) <= 2 * 3 * 3, opened
    everything = _keys(spark, 0)
    for n in range(1, 19):
        everything = everything.unionByName(_keys(spark, n))
    assert everything.join(index.lookup(everything, 99), ["ix_name", "signature"], "left_anti").count() == 0
    # a replay sees only what came before its batch, and publishes the same
    assert index.lookup(_keys(spark, 18), 18).join(_keys(spark, 18), ["signature"], "left_semi").count() == 0
    index.add(_keys(spark, 18), 18)
    assert index.lookup(everything, 99).count() == 19 * 40


def test_failed_first_attempt_is_not_taken_for_stored(spark, sf_small, monkeypatch):
    """The first batch ever dies between its rows and its index; the next attempt stores everything."""
    tx = B.transactions(spark, sf_small).where("slot < 300")
    sink = tempfile.mkdtemp(prefix="died-", dir="/tmp")
    with monkeypatch.context() as m:
        m.setattr(KeyIndex, "add", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            P.process_transactions(tx, 0, sink, B.IDL, B.PID)
    P.process_transactions(tx, 0, sink, B.IDL, B.PID)
    P.process_transactions(tx, 1, sink, B.IDL, B.PID)
    assert _stored_rows(P.read_stored(spark, sink)) == _stored_rows(B.ingest_instructions(spark, sf_small).where("slot < 300"))


def test_gap_fill_ledger(spark, sf_small):
    tx = B.transactions(spark, sf_small).where("slot < 400")
    listing = tx.select("signature", "slot")
    archive = tx.where("slot % 7 <> 0")  # holds not everything either
    sink = tempfile.mkdtemp(prefix="fill-", dir="/tmp")
    for n, cond in enumerate(["slot % 5 = 1", "slot % 5 = 2"]):
        P.process_transactions(tx.where(cond), n, sink, B.IDL, B.PID, listing=listing, gap_every=1,
                               gap_requires_progress=False, archive=archive)
    stored = _stored_rows(P.read_stored(spark, sink))
    want = B.ingest_instructions(spark, sf_small).where("slot < 400 AND (slot % 5 IN (1, 2) OR slot % 7 <> 0)")
    assert stored == _stored_rows(want)
    ledger = spark.read.parquet(f"{sink}/gap_ledger")
    first = {r["signature"]: r for r in ledger.where("batch_id = 0").collect()}
    last = {r["signature"]: r for r in ledger.where("batch_id = 1").collect()}
    assert {r["outcome"] for r in first.values()} == {"stored", "skipped", None}
    # only what the archive lacked is looked for again, and counted on
    assert set(last) <= {s for s, r in first.items() if r["outcome"] is None} and last
    assert all(r["first_listed"] == 0 and r["attempts"] == 2 for r in last.values())
    assert all((r["filled_by"] is None) == (r["outcome"] is None) for r in first.values())
    P.fill_gaps(spark, 1, sink, B.IDL, B.PID, archive)
    assert _stored_rows(P.read_stored(spark, sink)) == stored


def test_gap_check_by_signature_in_the_stream(spark, sf_small):
    tx = B.transactions(spark, sf_small).where("slot < 200")
    sink = tempfile.mkdtemp(prefix="sig-", dir="/tmp")
    have = tx.where("tx_index <> 2")  # a slot is seen although one of its transactions is not
    P.process_transactions(have, 0, sink, B.IDL, B.PID, listing=tx.select("signature", "slot"), gap_every=1, gap_on="signature")
    got = {r["signature"] for r in spark.read.parquet(f"{sink}/gaps").collect()}
    done = {r["signature"] for r in have.where("meta.err IS NULL").collect()}
    assert got == {r["signature"] for r in tx.collect()} - done


def test_seen_slots_are_islands(spark):
    rnd = random.Random(2)
    store = SeenSlots(spark, tempfile.mkdtemp(prefix="seen-", dir="/tmp"), bucket_slots=50)
    seen = set()
    for n in range(4):
        slots = {rnd.randrange(400) for _ in range(60)} | set(range(100 * n, 100 * n + 30))
        seen |= slots
        store.add(spark.createDataFrame([(s,) for s in slots] + [(min(slots),)], "slot bigint"), n)
    rows = store.read().collect()
    assert {x for r in rows for x in range(r["lo"], r["hi"] + 1)} == seen
    assert len(rows) <= 8 + sum(s - 1 not in seen for s in seen)
    assert {x for r in store.read(3).collect() for x in range(r["lo"], r["hi"] + 1)} < seen
    listing = spark.createDataFrame([(f"a{i}", i) for i in range(420)] * 2 + [("n", None)], "signature string, slot bigint")
    got = sorted(r["slot"] for r in seen_slots.gaps(listing, store.read(), 50).collect())
    assert got == sorted(2 * [i for i in range(420) if i not in seen])


def test_snapshot_touches_only_its_buckets(spark):
    root = tempfile.mkdtemp(prefix="snap-", dir="/tmp")
    snap = P.account_snapshot(spark, root, 16)
    rnd, rows = random.Random(3), []
    schema = "account_type string, pubkey string, slot bigint, seq bigint, v string"
    for n in range(6):
        new = [("T", f"k{rnd.randrange(6 if n else 60)}", rnd.randrange(1000), n, f"v{n}{i}") for i in range(30)]
        before = snap.store.versions()
        touched = snap.apply(spark.createDataFrame(new, schema), n, compact_after=3)
        rows += new
        after = snap.store.versions()
        assert {b for b in after if after[b] != before.get(b)} == set(touched)
        assert n == 0 or len(touched) <= 6
        assert all(len(v) <= 3 for v in after.values())
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        want[r[1]] = (r[2], r[3])
    assert {r["pubkey"]: (r["slot"], r["seq"]) for r in snap.read().collect()} == want
    # a replayed version publishes the same
    state = snap.store.versions()
    snap.apply(spark.createDataFrame(new, schema), 5, compact_after=3)
    assert snap.store.versions() == state
    assert BucketStore(spark, root + "/none").read() is None
