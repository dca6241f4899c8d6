"""Structured Streaming pipelines (J-1..J-4, A-6, A-10).

Each pipeline is ``readStream`` (file source here; Kafka works the same) ->
``foreachBatch``. Inside a micro-batch the work is the batch job of the
same name. Exactly-once comes from two rules:

* every micro-batch writes only to its own ``batch_id=<n>`` folders, with
  overwrite, so a replayed batch replaces its earlier attempt;
* insert-ignore compares against the keys indexed by the batches *before*
  ``n`` only (``key_index``), so a replay does not see its own first attempt.

Offsets live in the Spark checkpoint (the shared ``spark.checkpoint.dir``),
which replaces the reference's key/value state table for recovery.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from progscan.operators import ingest as I
from progscan.operators import store as S
from progscan.plans.idl import Idl
from progscan.sources import manifest as M
from progscan.sources.derived import RAW_ACCOUNT_SCHEMA, TX_SCHEMA
from progscan.sources.staging import path_exists
from progscan.sources.transactions import SLOT_BUCKET, scan
from progscan.streaming import seen_slots
from progscan.streaming.bucket_store import SNAPSHOT_BUCKETS, Snapshot
from progscan.streaming.key_index import FANOUT, KeyIndex
from progscan.streaming.rollups import Rollups
from progscan.streaming.seen_slots import SeenSlots

BACKFILL_BATCH = -1

#: A table of all transactions (frame or path), or what returns those of a frame (signature, slot).
Archive = DataFrame | str | Callable[[DataFrame], DataFrame]


def sequence(batch_id: int) -> int:
    """Place of a batch in the order of writes: the backfill, then batch 0, the gap fill after it, batch 1, ..."""
    return 2 * batch_id + 2 if batch_id >= BACKFILL_BATCH else 2 * (BACKFILL_BATCH - 1 - batch_id) + 3


def fill_batch_id(check_id: int) -> int:
    """The batch id of the gap fill that follows the check of batch ``check_id``."""
    return BACKFILL_BATCH - 1 - check_id


def arrival_order(df: DataFrame) -> list[str]:
    return ["slot", "id"] + [c for c in df.columns if c not in ("ix_name", "signature", "slot", "id")]


# Fixed value that must equal the reference's: gap check on every 6th cycle.
GAP_CHECK_EVERY = 6


def _ok():
    return F.col("meta").isNotNull() & F.col("meta.err").isNull()


def _indexed(spark: SparkSession, sink: str, batch_id: int, fanout: int) -> KeyIndex:
    """The key index of the instruction table. A store that earlier versions wrote without one is indexed first; a
    first attempt of this very batch is not part of it."""
    index = KeyIndex(spark, f"{sink}/keys", fanout)
    if index.empty():
        stored = S.read_table(spark, f"{sink}/instructions")
        if stored is not None:
            b = F.col("batch_id")
            order = F.when(b >= BACKFILL_BATCH, 2 * b + 2).otherwise(2 * (BACKFILL_BATCH - 1 - b) + 3)
            old = stored.where(order < F.lit(sequence(batch_id))).select("ix_name", "signature")
            if not old.isEmpty():
                index.add(old, M.LOWEST + 1)
    return index


def _ingest(batch: DataFrame, batch_id: int, sink: str, idl: Idl, program_id: str, track: str | None,
            fanout: int = FANOUT, rollups: bool = False) -> None:
    """Decode and store one batch: instructions once per key, events, state; ``track`` notes what was processed."""
    spark, seq = batch.sparkSession, sequence(batch_id)
    earlier = M.latest(spark, f"{sink}/_checkpoint", seq)
    checkpoint = earlier[1]["slot"] if earlier else 0
    index = _indexed(spark, sink, batch_id, fanout)
    key = ["ix_name", "signature"]
    # the columns of a decode that nobody reads are not computed: its keys are matched rows only
    keys = index.lookup(I.decode_instructions(batch, idl, program_id).select(*key), seq)

    def pick(matched: DataFrame) -> DataFrame:
        """Of the rows whose payload matches: those that may be stored. Only these are decoded."""
        first = S.may_be_first(matched, key, ["slot", "id"])
        return first if keys is None else first.join(keys, key, "left_anti")

    dec = I.decode_instructions(batch, idl, program_id, pick=pick)
    new = S.first_per_key(dec, key, arrival_order(dec))
    # J-6: a row is late if its slot is at or below the checkpoint that earlier batches left
    new = new.withColumn("late", F.col("slot") <= F.lit(checkpoint) if earlier else F.lit(False))
    ob_ix = Observation(f"ix_{seq}")
    new = new.observe(ob_ix, F.count(F.lit(1)).alias("instructions_stored"), F.count_if("late").alias("instructions_late"))
    S.overwrite_batch(new.sortWithinPartitions("ix_name", "slot", "id"), f"{sink}/instructions", batch_id, ["ix_name"],
                      bloom=["signature"])
    # F-13 per micro-batch: counters ride along with the events' read of the source
    counters = [F.max(F.when(_ok(), F.col("slot"))).alias("top"), F.count_if(_ok()).alias("tx_ok"),
                F.count_if(~_ok()).alias("tx_skipped")]
    if idl.events:
        ob_tx, ob_ev = Observation(f"tx_{seq}"), Observation(f"ev_{seq}")
        ev = I.decode_events(batch.observe(ob_tx, *counters), idl).observe(ob_ev, F.count(F.lit(1)).alias("events_decoded"))
        S.overwrite_batch(ev, f"{sink}/events", batch_id)
        tx, events = ob_tx.get, ob_ev.get["events_decoded"]
    else:
        tx, events = batch.agg(*counters).first().asDict(), 0
    state = {"last_processed_slot": max(tx["top"] or 0, 0), "tx_ok": tx["tx_ok"], "tx_skipped": tx["tx_skipped"],
             "instructions_stored": ob_ix.get["instructions_stored"], "instructions_late": ob_ix.get["instructions_late"],
             "events_decoded": events}
    S.overwrite_batch(spark.createDataFrame([tuple(map(int, state.values()))], ", ".join(f"{c} bigint" for c in state)),
                      f"{sink}/state", batch_id)
    if track:
        done = batch.where(_ok())
        SeenSlots(spark, f"{sink}/seen_slots").add(done, seq)
        if track == "signature":
            KeyIndex(spark, f"{sink}/tx_keys", fanout).add(done.select(F.lit("").alias("ix_name"), "signature").distinct(), seq)
    if rollups:
        rows = spark.read.schema(new.schema).parquet(f"{sink}/instructions/batch_id={batch_id}")
        Rollups(spark, f"{sink}/rollups").add(rows, seq)
    # last: what makes the batch known to later ones
    written = spark.read.schema("ix_name string, signature string").parquet(f"{sink}/instructions/batch_id={batch_id}")
    index.add(written.select("ix_name", "signature"), seq)
    M.publish(spark, f"{sink}/_checkpoint", seq, {"slot": max(checkpoint, state["last_processed_slot"])})


def process_transactions(batch: DataFrame, batch_id: int, sink: str, idl: Idl, program_id: str,
                         listing: DataFrame | str | None = None, gap_every: int = GAP_CHECK_EVERY,
                         gap_requires_progress: bool = True, archive: Archive | None = None,
                         gap_on: str = "slot", fanout: int = FANOUT, rollups: bool = False) -> None:
    """One micro-batch: decode, insert-ignore instructions, append events, checkpoint.

    ``rollups`` also keeps partial states per type and hour (``rollups.Rollups``).

    With a ``listing`` (what the chain lists for the program; a path is read anew each time), every
    ``gap_every``-th batch also writes the gap check (listed signatures whose slot, or with
    ``gap_on="signature"`` which themselves, were never processed, H-2/J-1) and the slot lag (J-7) for that batch.
    With an ``archive`` (a table of all transactions, frame or path, or a function that returns the transactions of a
    frame of signatures and slots) what is missing is fetched from it and processed as a batch of its own (``fill_gaps``)."""
    if gap_on not in ("slot", "signature"):
        raise ValueError("gap_on is 'slot' or 'signature'")
    spark = batch.sparkSession
    _ingest(batch, batch_id, sink, idl, program_id, gap_on if listing is not None else None, fanout, rollups)
    if listing is None or batch_id < 0 or batch_id % gap_every:
        return
    if gap_requires_progress and not _checkpoint_moved(spark, sink, batch_id):
        return
    from progscan.operators import quality as Qa

    if isinstance(listing, str):  # listed anew at each check: files added later count
        listing = spark.read.parquet(listing).select("signature", "slot")
    after = sequence(batch_id) + 1
    seen = SeenSlots(spark, f"{sink}/seen_slots").read(after)
    if gap_on == "slot":
        missing = seen_slots.gaps(listing, seen)
    else:
        known = KeyIndex(spark, f"{sink}/tx_keys").lookup(listing.select(F.lit("").alias("ix_name"), "signature"), after)
        missing = listing if known is None else Qa.gaps(listing, known, on="signature").select(*listing.columns)
    S.overwrite_batch(missing, f"{sink}/gaps", batch_id)
    S.overwrite_batch(Qa.slot_lag(listing, seen.select(F.col("hi").alias("slot"))), f"{sink}/lag", batch_id)
    if archive is not None:
        fill_gaps(spark, batch_id, sink, idl, program_id, archive, gap_on, rollups)


#: Slot buckets of missing transactions are listed up to this many to prune the archive; beyond it all of it is read.
LISTED_BUCKETS = 4096


def fill_gaps(spark: SparkSession, check_id: int, sink: str, idl: Idl, program_id: str, archive: Archive,
              track: str = "slot", rollups: bool = False) -> None:
    """H-2 / J-1: fetch and process what the check of batch ``check_id`` found missing.

    The missing signatures are semi-joined with the archive (pruned to their
    slot buckets where it is partitioned by them; an archive that is a function
    does so itself) and processed as a batch with
    an id of its own, between this batch and the next, so a replay rewrites it
    and adds nothing. The ledger gets one row per missing transaction: the
    check that listed it first, how often it was looked for, the fill batch and
    the outcome ('stored', 'skipped' for a failed transaction, null if the
    archive does not hold it). What was skipped is not looked for again.
    """
    fill_id = fill_batch_id(check_id)
    missing = spark.read.parquet(f"{sink}/gaps/batch_id={check_id}").select("signature", "slot").distinct()
    ledger = S.read_table(spark, f"{sink}/gap_ledger")
    if ledger is not None:
        ledger = ledger.where(F.col("batch_id") < check_id)
        missing = missing.join(ledger.where("outcome = 'skipped'").select("signature"), "signature", "left_anti")
    # the archive is searched once; ingest and ledger read what was found several times
    fetched = f"{sink}/fetched/batch_id={fill_id}"
    try:
        found = scan(_from_archive(spark, archive, missing)).select(*[f.name for f in TX_SCHEMA.fields])
        found.write.mode("overwrite").option("compression", "zstd").parquet(fetched)
        found = spark.read.schema(TX_SCHEMA).parquet(fetched)
        _ingest(found, fill_id, sink, idl, program_id, track, rollups=rollups)
        outcome = found.select("signature", F.when(_ok(), "stored").otherwise("skipped").alias("outcome"))
        # one row per signature: a transaction that the archive holds twice is stored if any copy succeeded
        outcome = outcome.groupBy("signature").agg(F.max("outcome").alias("outcome"))
        _note_outcome(missing, outcome, ledger, check_id, fill_id, sink)
    finally:
        M.remove(spark, fetched)


def _from_archive(spark: SparkSession, archive: Archive, missing: DataFrame) -> DataFrame:
    """The archive's transactions whose signature is missing."""
    if callable(archive):
        return archive(missing)
    if isinstance(archive, str):
        archive = spark.read.parquet(archive)
    if "slot_bucket" in archive.columns:
        rows = missing.select(F.floor(F.col("slot") / SLOT_BUCKET).alias("b")).distinct().limit(LISTED_BUCKETS + 1).collect()
        if len(rows) <= LISTED_BUCKETS:
            archive = archive.where(F.col("slot_bucket").isin([r["b"] for r in rows]))
    return archive.join(missing.select("signature"), "signature", "left_semi")


def _note_outcome(missing: DataFrame, outcome: DataFrame, ledger: DataFrame | None, check_id: int, fill_id: int,
                  sink: str) -> None:
    """The ledger's rows of one fill."""
    rows = missing.join(outcome, "signature", "left")
    if ledger is not None:
        past = ledger.groupBy("signature").agg(F.min("first_listed").alias("first_listed"), F.max("attempts").alias("attempts"))
        rows = rows.join(past, "signature", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("bigint") for c in ("first_listed", "attempts")})
    rows = rows.select("signature", "slot", F.coalesce("first_listed", F.lit(check_id)).cast("bigint").alias("first_listed"),
                       (F.coalesce("attempts", F.lit(0)) + 1).cast("bigint").alias("attempts"),
                       F.when(F.col("outcome").isNotNull(), F.lit(fill_id)).cast("bigint").alias("filled_by"), "outcome")
    S.overwrite_batch(rows, f"{sink}/gap_ledger", check_id)


def _checkpoint_moved(spark: SparkSession, sink: str, batch_id: int) -> bool:
    """H-2: the gap check runs only when the checkpoint moved since the previous check."""
    now = M.latest(spark, f"{sink}/_checkpoint", sequence(batch_id) + 1)
    if not path_exists(spark, f"{sink}/lag"):
        return True
    checked = (spark.read.parquet(f"{sink}/lag").where(F.col("batch_id") < batch_id)
               .agg(F.max("last_processed_slot")).first()[0])
    return checked is None or (now[1]["slot"] if now else 0) > checked


SNAPSHOT_KEY, SNAPSHOT_ORDER = ["account_type", "pubkey"], ["slot", "seq"]


def account_snapshot(spark: SparkSession, sink: str, buckets: int = SNAPSHOT_BUCKETS) -> Snapshot:
    """B-4 / B-6: the maintained snapshot of an account sink."""
    return Snapshot(spark, f"{sink}/snapshot", SNAPSHOT_KEY, SNAPSHOT_ORDER, buckets)


def process_accounts(batch: DataFrame, batch_id: int, sink: str, idl: Idl, buckets: int = SNAPSHOT_BUCKETS) -> list[int]:
    """One micro-batch of account changes: decode, append to history (B-6), update the snapshot (B-4).

    Returns the snapshot buckets that the batch touched."""
    hist = I.decode_accounts(batch, idl)
    S.overwrite_batch(hist.drop("data").sortWithinPartitions("pubkey", "slot"), f"{sink}/history", batch_id, bloom=["pubkey"])
    rows = batch.sparkSession.read.schema(hist.drop("data").schema).parquet(f"{sink}/history/batch_id={batch_id}")
    return account_snapshot(batch.sparkSession, sink, buckets).apply(rows, sequence(batch_id))


def resync_accounts(accounts: DataFrame, slot: int, batch_id: int, sink: str, idl: Idl,
                    buckets: int = SNAPSHOT_BUCKETS) -> list[int]:
    """J-8 / A-8: a sweep of an account dump written to history and snapshot alike, at the sweep's slot.

    Every account of a known type is observed at ``slot``, unchanged ones
    included; accounts that the dump does not hold keep their last state."""
    at = accounts.drop("slot", "seq").withColumns({"slot": F.lit(slot).cast("bigint"), "seq": F.lit(0).cast("bigint")})
    return process_accounts(at, batch_id, sink, idl, buckets)


def start_transactions(spark: SparkSession, source: str, sink: str, checkpoint: str, idl: Idl, program_id: str,
                       fmt: str = "parquet", files_per_trigger: int | None = None,
                       available_now: bool = True, processing_time: str | None = None,
                       listing: DataFrame | str | None = None, gap_every: int = GAP_CHECK_EVERY,
                       gap_requires_progress: bool = True, archive: Archive | None = None,
                       gap_on: str = "slot", rollups: bool = False):
    """J-1 / A-6: stream transactions into the stored tables.

    ``available_now`` drains what is there (batch mode J-2 and tests);
    ``processing_time="5 seconds"`` is the realtime poll interval."""
    r = spark.readStream.schema(TX_SCHEMA).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    src = r.load(source)
    w = src.writeStream.foreachBatch(
        lambda df, bid: process_transactions(df, bid, sink, idl, program_id, listing, gap_every,
                                             gap_requires_progress, archive, gap_on, rollups=rollups)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "5 seconds")
    return w.start()


def start_accounts(spark: SparkSession, source: str, sink: str, checkpoint: str, idl: Idl,
                   files_per_trigger: int | None = None, available_now: bool = True):
    """A-10: stream account changes into the append-only history."""
    r = spark.readStream.schema(RAW_ACCOUNT_SCHEMA + ", seq bigint").format("parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    src = r.load(source)
    w = src.writeStream.foreachBatch(lambda df, bid: process_accounts(df, bid, sink, idl)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_stored(spark: SparkSession, sink: str, table: str = "instructions") -> DataFrame:
    """A stored table; columns that later IDL versions added are NULL in older batches."""
    df = S.read_table(spark, f"{sink}/{table}")
    if df is None:
        raise FileNotFoundError(f"{sink}/{table} holds no data")
    return df.drop("batch_id", "sig_bucket")  # the latter in stores of earlier versions


def backfill(tx: DataFrame, sink: str, idl: Idl, program_id: str) -> None:
    """J-3 first half: a batch range written into the same sink as batch -1, so every
    streamed batch (0, 1, ...) sees it as earlier and skips what it already holds."""
    process_transactions(tx, BACKFILL_BATCH, sink, idl, program_id)


SLOT_CLOCK_BASE_MS = 946_684_800_000  # 2000-01-01: keeps slot 0 above the initial watermark


def dedup_within_watermark(stream: DataFrame, delay: str = "10 minutes", key: str = "signature",
                           slot_ms: int = 400) -> DataFrame:
    """J-4 bounded option: drop replays of a key that arrive within ``delay`` of event
    time. State is bounded by the watermark, unlike the exact path above, which
    compares against everything stored.

    Event time is the slot on the chain's clock (base + ``slot * slot_ms``, TIMESTAMP):
    every row has one (block time can be missing, and a missing time must not make
    a row "late" and drop it), and it follows chain order."""
    t = stream.withColumn("__event_time",
                          F.timestamp_millis(F.lit(SLOT_CLOCK_BASE_MS) + F.col("slot") * F.lit(slot_ms)))
    return t.withWatermark("__event_time", delay).dropDuplicatesWithinWatermark([key]).drop("__event_time")
