"""The command line end to end: two overlapping batch ranges, then page, aggregate, stats."""

import json
import tempfile

from progscan import cli
from progscan.jobs import _base as B
from progscan.sources.derived import ACTIVITY_IDL_DOC


def test_cli_batch_ingest_and_queries(spark, sf_small, capsys):
    base = tempfile.mkdtemp(prefix="cli-", dir="/tmp")
    B.transactions(spark, sf_small).write.parquet(f"{base}/tx")
    with open(f"{base}/idl.json", "w") as fh:
        json.dump(ACTIVITY_IDL_DOC, fh)
    common = ["--idl", f"{base}/idl.json", "--sink", f"{base}/store"]
    src = ["--program", B.PID, "--source", f"{base}/tx"]
    first = cli.main(["ingest", *common, *src, "--from-slot", "0", "--to-slot", "600"], spark)
    second = cli.main(["ingest", *common, *src, "--from-slot", "400"], spark)  # overlaps the first range
    assert first["batch_id"] == 0 and second["batch_id"] == 1
    stored = spark.read.parquet(f"{base}/store/instructions").drop("batch_id")
    want = B.ingest_instructions(spark, sf_small)
    key = ["ix_name", "signature", "slot", "id", "arg_amount", "arg_price"]
    assert sorted(map(tuple, stored.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))

    page = cli.main(["query", *common, "--instruction", "click", "--limit", "5", "--filter", "arg_k=7"], spark)
    assert len(page["rows"]) <= 5 and all(r["arg_k"] == "7" for r in page["rows"])
    assert page["total"] == want.where("ix_name = 'click' AND arg_k = '7'").count()
    agg = cli.main(["aggregate", *common, "--instruction", "purchase", "--group-by", "total", "--op", "sum",
                    "--field", "arg_amount"], spark)
    assert agg["rows"][0]["total_calls"] == want.where("ix_name = 'purchase'").count()
    stats = cli.main(["stats", *common], spark)
    assert stats["instructions"]["error"]["total"] == 0 and stats["events"]["ValueRecorded"] > 0
    capsys.readouterr()


def test_cli_stream_accounts(spark, sf_small, capsys):
    from progscan.operators import accounts as A

    base = tempfile.mkdtemp(prefix="cli-acc-", dir="/tmp")
    B.account_updates(spark, sf_small).repartition(3, "slot").write.parquet(f"{base}/src")
    with open(f"{base}/idl.json", "w") as fh:
        json.dump(ACTIVITY_IDL_DOC, fh)
    out = cli.main(["stream-accounts", "--idl", f"{base}/idl.json", "--sink", f"{base}/store", "--source",
                    f"{base}/src", "--checkpoint", f"{base}/ck", "--available-now", "--files-per-trigger", "1"], spark)
    assert out["active"] is False
    hist = spark.read.parquet(f"{base}/store/history")
    assert hist.count() == B.account_updates(spark, sf_small).count()
    snap = A.snapshot(hist.drop("batch_id", "data", "account_type"))
    assert snap.count() == hist.select("pubkey").distinct().count()
    capsys.readouterr()


    # a sweep of the same accounts at a later slot goes to history and snapshot
    dump = B.account_updates(spark, sf_small).orderBy("slot").dropDuplicates(["pubkey"])
    dump.write.parquet(f"{base}/dump")
    common = ["--sink", f"{base}/store"]
    swept = cli.main(["resync", "--idl", f"{base}/idl.json", *common, "--source", f"{base}/dump", "--slot", "999999"], spark)
    assert swept["accounts"] == {"Customer": dump.count()} and swept["batch_id"] == out_batches(spark, base)
    key = dump.first()["pubkey"]
    now = cli.main(["accounts", *common, "--pubkey", key], spark)["rows"]
    assert [r["slot"] for r in now] == [999999]
    page = cli.main(["accounts", *common, "--pubkey", key, "--history", "--limit", "2"], spark)["rows"]
    assert page[0]["slot"] == 999999 and len(page) <= 2 and page == sorted(page, key=lambda r: -r["slot"])


def out_batches(spark, base):
    return spark.read.parquet(f"{base}/store/history").agg({"batch_id": "max"}).first()[0]


def test_cli_versions(spark, sf_small, capsys):
    from progscan.sources import derived as D

    base = tempfile.mkdtemp(prefix="cli-idl-", dir="/tmp")
    docs = D.idl_deployments(spark, sf_small)
    docs.write.parquet(f"{base}/docs")
    program = docs.first()["program_id"]
    out = cli.main(["versions", "--source", f"{base}/docs", "--program", program], spark)
    slots = [v["slot"] for v in out["versions"]]
    assert slots == sorted(slots) and [v["version_no"] for v in out["versions"]] == list(range(1, len(slots) + 1))
    assert {r["kind"] for r in out["current"]} == {"instruction", "account", "event"}
    assert any(r["name"] == "initialize" and r["fields"] == ["bump: u8"] for r in out["current"])
