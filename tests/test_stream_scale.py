"""What the streams shuffle, decode and keep on disk."""

import glob
import os
import random
import re
import tempfile

from pyspark.sql import functions as F

from progscan.jobs import _base as B
from progscan.jobs import stream_jobs as J
from progscan.operators import ingest as I
from progscan.operators import store as S
from progscan.plans.decode import decode_fields
from progscan.plans.idl import Field
from progscan.plans.readers import read_fields, reader, shape_of
from progscan.session import dropped_shuffles
from progscan.streaming import pipelines as P


def _rows(df):
    return sorted(map(str, df.collect()))


def _below(plan, node):
    """The lines of a plan that stand below such a node."""
    depth = [re.search(r"[A-Za-z]", line).start() if re.search(r"[A-Za-z]", line) else 0 for line in plan]
    out = []
    for i, line in enumerate(plan):
        if line[depth[i]:].startswith(node):
            for d, x in zip(depth[i + 1:], plan[i + 1:]):
                if d <= depth[i]:
                    break
                out.append(x)
    return out


def test_archive_shuffles_narrow_rows(spark, sf_small):
    tx = B.transactions(spark, sf_small)
    missing = tx.where("slot % 5 = 0 AND slot < 900").select("signature", "slot")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = J._fetch(spark, sf_small)(missing)
        plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
        below = _below(plan, "Exchange")
        assert any("InstructionError" in line for line in plan) and len([x for x in plan if "SortMergeJoin" in x]) == 2
        assert below and not any("InstructionError" in line for line in below)  # records are built above the joins
        assert _rows(found) == _rows(tx.join(missing.select("signature"), "signature", "left_semi").select(*tx.columns))
        assert J._fetch(spark, sf_small)(missing.where("false")).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_gap_fill_from_a_function(spark, sf_small):
    tx = B.transactions(spark, sf_small).where("slot < 300")
    sinks = []
    for archive in (tx, lambda missing: J._fetch(spark, sf_small)(missing).where("slot < 300")):
        sinks.append(tempfile.mkdtemp(prefix="fn-", dir="/tmp"))
        P.process_transactions(tx.where("slot % 5 <> 0"), 0, sinks[-1], B.IDL, B.PID, listing=tx.select("signature", "slot"),
                               gap_every=1, gap_requires_progress=False, archive=archive)
    assert _rows(P.read_stored(spark, sinks[0])) == _rows(P.read_stored(spark, sinks[1]))
    assert not glob.glob(f"{sinks[1]}/fetched/*/*.parquet")


def test_bloom_filters_fit_small_files(spark):
    path = tempfile.mkdtemp(prefix="bloom-", dir="/tmp")
    S.overwrite_batch(spark.range(100).select(F.col("id").cast("string").alias("signature")).coalesce(1), path, 0, bloom=["signature"])
    assert sum(os.path.getsize(f) for f in glob.glob(f"{path}/batch_id=0/*.parquet")) < 200_000


def test_shuffle_files_go_with_their_execution(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with dropped_shuffles(spark):
        assert spark.conf.get(key) == "true"
        assert spark.range(1000).repartition(3, "id").groupBy("id").count().count() == 1000
    assert spark.conf.get(key) == before


def test_only_rows_to_store_are_decoded(spark, sf_small, monkeypatch):
    tx, sink = B.transactions(spark, sf_small).where("slot < 300"), tempfile.mkdtemp(prefix="once-", dir="/tmp")
    decode, decoded = I.decode_by_definition, []

    def noted(df, name_col, *a, **b):
        if name_col == "ix_name":
            decoded.append(df)
        return decode(df, name_col, *a, **b)

    monkeypatch.setattr(I, "decode_by_definition", noted)
    P.process_transactions(tx, 0, sink, B.IDL, B.PID)
    first = P.read_stored(spark, sink)
    # a sibling call under the same key is left out; rows that only their values tell apart stay
    assert decoded[-1].select("ix_name", "signature").distinct().count() == first.count()
    assert decoded[-1].groupBy("ix_name", "signature").agg(F.count_distinct("slot", "id").alias("n")).where("n > 1").isEmpty()
    P.process_transactions(tx.unionByName(tx), 1, sink, B.IDL, B.PID)
    assert decoded[-1].count() == 0
    assert P.read_stored(spark, sink).count() == first.count()


def test_equal_places_are_told_apart_by_what_is_decoded(spark, sf_small):
    """Two transactions with one signature, slot and index: the first by all columns stays, as in one batch ingest."""
    tx = B.transactions(spark, sf_small).where("slot < 300")
    other = tx.withColumn("blockTime", F.col("blockTime") - 7)
    sink = tempfile.mkdtemp(prefix="ties-", dir="/tmp")
    P.process_transactions(tx.unionByName(other), 0, sink, B.IDL, B.PID)
    dec = I.decode_instructions(tx.unionByName(other), B.IDL, B.PID)
    want = S.insert_ignore(dec, ["ix_name", "signature"], B.arrival_order(dec))
    cols = sorted(want.columns)
    assert _rows(P.read_stored(spark, sink).select(*cols)) == _rows(want.select(*cols))


def test_source_is_replayed_from_its_files(spark, sf_small, monkeypatch):
    written = []
    monkeypatch.setattr(J, "_write_source", lambda *a, f=J._write_source, **b: (written.append(a), f(*a, **b)))
    out = J.stream_dedup(spark, sf_small)
    assert len(written) == 1
    assert out.count() == B.ingest_instructions(spark, sf_small).count()
    src = written[0][2]
    assert spark.read.parquet(src).count() == 2 * B.transactions(spark, sf_small).count()
    state = spark.read.parquet(src.removesuffix("/source") + "/sink/state").orderBy("batch_id").collect()
    assert len(state) == 3 and sum(r["instructions_stored"] for r in state) == out.count()
    assert state[-1]["tx_ok"] > 0 and state[-1]["instructions_stored"] == 0  # only copies


def test_integers_are_placed_by_the_payload_length(spark):
    rnd = random.Random(5)
    for types in (["u64", "u16", "u32"], ["u64", "u64", "u8"], ["i32", "i8", "i64", "i16"], ["u8", "u64", "u32", "u16", "i8"]):
        total = 8 + sum(int(t[1:]) // 8 for t in types)
        payloads = [bytes(rnd.randrange(256) for _ in range(n)) for n in range(total + 3)] * 2
        df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, raw binary")
        fields = [Field(f"f{k}", t) for k, t in enumerate(types)]
        names = [f.name for f in fields]
        out = decode_fields(df, "raw", fields, names, js_values=[f"j_{n}" for n in names])
        assert "__off" not in out._jdf.queryExecution().analyzed().toString()
        readers = [reader(shape_of(t), False) for t in types]
        for r in out.collect():
            texts, fragments = read_fields(readers, payloads[r["i"]])
            assert [r[n] for n in names] == texts and [r[f"j_{n}"] for n in names] == fragments, (types, payloads[r["i"]])
