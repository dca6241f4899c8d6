"""Command line for spark-submit: batch ingest, streaming ingest, pages, aggregates, stats.

    spark-submit --py-files progscan.zip progscan/cli.py ingest --idl idl.json --program <id> \
        --source tx/ --sink store/ [--from-slot A] [--to-slot B]
    spark-submit ... progscan/cli.py stream --idl idl.json --program <id> --source tx/ --sink store/ \
        --checkpoint ckpt/ [--trigger "5 seconds" | --available-now] [--listing listing/]
    spark-submit ... progscan/cli.py query --idl idl.json --sink store/ --instruction swap --limit 50
    spark-submit ... progscan/cli.py aggregate --idl idl.json --sink store/ --instruction swap \
        --group-by hour --op sum --field arg_amountin

Store layout under ``--sink``: ``instructions/batch_id=<n>/``, ``events/batch_id=<n>/``,
``state/batch_id=<n>/`` (checkpoint and counters per batch), plus ``seen/``,
``gaps/`` and ``lag/`` when a listing is given. Each command prints one JSON
document on stdout.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

if __package__ in (None, ""):  # run as a script (spark-submit progscan/cli.py ...)
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from progscan.operators import accounts as A  # noqa: E402
from progscan.operators import ingest as I  # noqa: E402
from progscan.operators import query as Q  # noqa: E402
from progscan.operators import versions as V  # noqa: E402
from progscan.plans.idl import Idl  # noqa: E402
from progscan.sources import transactions as X  # noqa: E402
from progscan.sources.staging import path_exists  # noqa: E402
from progscan.streaming import pipelines as P  # noqa: E402
from progscan.streaming.rollups import Rollups  # noqa: E402


def _idl(path: str) -> Idl:
    with open(path, encoding="utf-8") as fh:
        return Idl.from_json(fh.read())


def _next_batch_id(spark: SparkSession, sink: str) -> int:
    if not path_exists(spark, f"{sink}/state"):
        return 0
    last = spark.read.parquet(f"{sink}/state").agg(F.max("batch_id")).first()[0]
    return 0 if last is None else int(last) + 1


def cmd_ingest(spark: SparkSession, a) -> dict:
    """J-2 batch mode: a slot range (both ends inclusive, 0 is a valid bound) into the store."""
    idl = _idl(a.idl)
    tx = X.read_transactions(spark, a.source, a.format)
    tx = X.slot_range(tx, a.from_slot, a.to_slot)
    batch_id = _next_batch_id(spark, a.sink)
    P.process_transactions(tx, batch_id, a.sink, idl, a.program)
    state = spark.read.parquet(f"{a.sink}/state").where(F.col("batch_id") == batch_id).first().asDict()
    state["last_processed_slot"] = spark.read.parquet(f"{a.sink}/state").agg(
        F.max("last_processed_slot")).first()[0]
    return {"batch_id": batch_id, **state}


def cmd_stream(spark: SparkSession, a) -> dict:
    """J-1 realtime mode (processing-time trigger) or drain-and-exit (``--available-now``)."""
    idl = _idl(a.idl)
    q = P.start_transactions(spark, a.source, a.sink, a.checkpoint, idl, a.program, a.format,
                             a.files_per_trigger, a.available_now, a.trigger, a.listing, archive=a.archive,
                             gap_on=a.gap_on, rollups=a.rollups)
    q.awaitTermination(a.timeout)
    return {"query_id": str(q.id), "active": q.isActive}


def cmd_stream_accounts(spark: SparkSession, a) -> dict:
    """A-10: account changes (pubkey, data, slot, seq) streamed into the append-only
    history; snapshots and as-of views are queries over it."""
    idl = _idl(a.idl)
    q = P.start_accounts(spark, a.source, a.sink, a.checkpoint, idl, a.files_per_trigger, a.available_now)
    q.awaitTermination(a.timeout)
    return {"query_id": str(q.id), "active": q.isActive}


def cmd_resync(spark: SparkSession, a) -> dict:
    """J-8: a sweep of an account dump (pubkey, data) into history and snapshot, at a slot."""
    idl = _idl(a.idl)
    path = f"{a.sink}/history"
    last = spark.read.parquet(path).agg(F.max("batch_id")).first()[0] if path_exists(spark, path) else None
    batch_id = 0 if last is None else int(last) + 1
    touched = P.resync_accounts(spark.read.parquet(a.source), a.slot, batch_id, a.sink, idl)
    counts = A.sweep(spark.read.parquet(a.source), idl).collect()
    return {"batch_id": batch_id, "buckets": len(touched), "accounts": {r["account_type"]: r["n_accounts"] for r in counts}}


def cmd_accounts(spark: SparkSession, a) -> dict:
    """B-4 / G-3: the last state of one account, or a page of its history."""
    rows = P.account_snapshot(spark, a.sink).read() if not a.history else P.read_stored(spark, a.sink, "history")
    if rows is None:
        return {"rows": []}
    if a.history:
        page = Q.history_page(rows.withColumnRenamed("seq", "id"), a.pubkey, a.limit, a.offset)
    else:
        page = rows.where(F.col("pubkey") == a.pubkey)
    return {"rows": [r.asDict() for r in page.collect()]}


def cmd_versions(spark: SparkSession, a) -> dict:
    """I-6 / D-7: the registered documents of a program and what its current one declares.

    The source is a table of documents (program_id, slot, idl_json)."""
    docs = V.register(spark.read.parquet(a.source).where(F.col("program_id") == a.program))
    history = V.history(docs).orderBy("version_no").select("version_no", "slot", "idl_hash").collect()
    current = V.listing(V.latest(docs)).select("kind", "name", "accounts", "fields").collect()
    return {"versions": [r.asDict() for r in history], "current": [r.asDict() for r in current]}


def cmd_query(spark: SparkSession, a) -> dict:
    """G-1 page of one instruction table: rows, total, nextCursor."""
    idl = _idl(a.idl)
    table = I.instruction_table(P.read_stored(spark, a.sink), idl, a.instruction)
    filters = dict(kv.split("=", 1) for kv in (a.filter or []))
    if a.slot_from is not None:
        filters["slot_from"] = a.slot_from
    if a.slot_to is not None:
        filters["slot_to"] = a.slot_to
    page = Q.page(table, a.limit, a.cursor, filters, with_total=True)
    return {"rows": [r.asDict() for r in page.rows.collect()], "total": page.total, "nextCursor": page.next_cursor}


def cmd_aggregate(spark: SparkSession, a) -> dict:
    """F-1..F-9 over one instruction table; with ``--rollups`` from the states that a sink keeps
    (one that was written with them from its first batch on)."""
    idl = _idl(a.idl)
    table = I.instruction_table(P.read_stored(spark, a.sink), idl, a.instruction)
    if a.rollups:
        if a.slot_from or a.slot_to:
            raise ValueError("states per hour have no slot range")
        out = Rollups(spark, f"{a.sink}/rollups").aggregate(a.instruction, a.group_by, a.op, a.field)
    else:
        out = Q.aggregate(table, a.group_by, a.op, a.field, a.slot_from, a.slot_to)
    return {"rows": [r.asDict() for r in out.collect()]}


def cmd_stats(spark: SparkSession, a) -> dict:
    """F-10 / F-11: per-instruction totals and event counts."""
    idl = _idl(a.idl)
    stored = P.read_stored(spark, a.sink)
    ix = {r["ix_name"]: {k: r[k] for k in ("total", "first_slot", "last_slot")}
          for r in Q.instruction_stats(stored, [i.name for i in idl.instructions]).collect()}
    ev = {}
    if path_exists(spark, f"{a.sink}/events"):
        ev = {r["event_name"]: r["count"] for r in Q.event_counts(P.read_stored(spark, a.sink, "events")).collect()}
    return {"program": idl.name, "instructions": ix, "events": ev}


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="progscan")
    sub = p.add_subparsers(dest="cmd", required=True)

    def common(sp, source=True):
        sp.add_argument("--idl", required=True)
        sp.add_argument("--sink", required=True)
        if source:
            sp.add_argument("--program", required=True)
            sp.add_argument("--source", required=True)
            sp.add_argument("--format", default="parquet", choices=["parquet", "json"])

    s = sub.add_parser("ingest")
    common(s)
    s.add_argument("--from-slot", type=int)
    s.add_argument("--to-slot", type=int)
    s = sub.add_parser("stream")
    common(s)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--trigger", default="5 seconds")
    s.add_argument("--available-now", action="store_true")
    s.add_argument("--files-per-trigger", type=int)
    s.add_argument("--listing", help="parquet table (signature, slot) for the periodic gap check")
    s.add_argument("--archive", help="parquet table of all transactions that missing ones are fetched from")
    s.add_argument("--gap-on", default="slot", choices=["slot", "signature"])
    s.add_argument("--rollups", action="store_true", help="keep aggregate states per type and hour")
    s.add_argument("--timeout", type=float, default=None)
    s = sub.add_parser("stream-accounts")
    common(s, source=False)
    s.add_argument("--source", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--available-now", action="store_true")
    s.add_argument("--files-per-trigger", type=int)
    s.add_argument("--timeout", type=float, default=None)
    s = sub.add_parser("resync")
    common(s, source=False)
    s.add_argument("--source", required=True)
    s.add_argument("--slot", type=int, required=True)
    s = sub.add_parser("accounts")
    s.add_argument("--sink", required=True)
    s.add_argument("--pubkey", required=True)
    s.add_argument("--history", action="store_true")
    s.add_argument("--limit", type=int)
    s.add_argument("--offset", type=int, default=0)
    s = sub.add_parser("versions")
    s.add_argument("--source", required=True)
    s.add_argument("--program", required=True)
    for name in ("query", "aggregate"):
        s = sub.add_parser(name)
        common(s, source=False)
        s.add_argument("--instruction", required=True)
        s.add_argument("--slot-from", type=int)
        s.add_argument("--slot-to", type=int)
        if name == "query":
            s.add_argument("--limit", type=int)
            s.add_argument("--cursor")
            s.add_argument("--filter", action="append", help="column=value (repeatable)")
        else:
            s.add_argument("--group-by", default="total", choices=["hour", "day", "total"])
            s.add_argument("--op", default="count", choices=list(Q.AGG_OPS))
            s.add_argument("--field")
            s.add_argument("--rollups", action="store_true")
    s = sub.add_parser("stats")
    common(s, source=False)
    return p


COMMANDS = {"ingest": cmd_ingest, "stream": cmd_stream, "stream-accounts": cmd_stream_accounts,
            "resync": cmd_resync, "accounts": cmd_accounts, "versions": cmd_versions, "query": cmd_query,
            "aggregate": cmd_aggregate, "stats": cmd_stats}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = build_parser().parse_args(argv)
    if spark is None:
        from progscan.session import get_session

        spark = get_session()
    out = COMMANDS[a.cmd](spark, a)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
