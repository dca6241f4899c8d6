"""What the jobs over stored tables write and shuffle: the tables they read, not the nested transactions."""

import glob
import os

from pyspark.sql import functions as F

from progscan.jobs import QUERIES
from progscan.jobs import _base as B
from progscan.session import ensure_checkpoint_dir
from progscan.sources.staging import _source_key


def test_only_the_table_read_is_written(spark, sf_small):
    folder = f"{ensure_checkpoint_dir(spark)}/staged/{_source_key(spark, sf_small)}".replace("file:", "")
    got = B.ix_table(spark, sf_small, "purchase")
    assert os.path.isdir(f"{folder}/ix_stored-purchase/ix_name=purchase")
    assert len(glob.glob(f"{folder}/ix_stored-purchase/ix_name=*")) == 1
    assert not os.path.exists(f"{folder}/transactions")
    whole = B.stored(spark, sf_small).where("ix_name = 'purchase'").select(*got.columns)
    assert got.count() > 0 and not got.exceptAll(whole).count() and not whole.exceptAll(got).count()


def test_type_is_matched_before_decode_and_dedup(spark, sf_small):
    one = B.ingest_instructions(spark, sf_small).where(F.col("ix_name").isin(["purchase"]))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "ix_name" in plan and plan.index("Window") < plan.rindex("purchase")
    assert "settle" not in "".join(x for x in plan.splitlines() if "Window" in x or "Filter" in x)


def test_json_transactions_are_compressed(spark, sf_small):
    before = set(glob.glob(f"{ensure_checkpoint_dir(spark)}/tx_json-*".replace("file:", "")))
    assert QUERIES["tx_scan_json"](spark, sf_small).count() == B.transactions(spark, sf_small).count()
    new, = set(glob.glob(f"{ensure_checkpoint_dir(spark)}/tx_json-*".replace("file:", ""))) - before
    parts = glob.glob(f"{new}/part-*")
    assert parts and all(p.endswith(".json.gz") for p in parts)


def test_failure_is_tested_without_building_records(spark, sf_small):
    """The filter on ``meta.err`` reads the source's own columns: no payload is built for it, nor decoded for the join."""
    one = B.ingest_instructions(spark, sf_small).where(F.col("ix_name").isin(["purchase"]))
    plan = one._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [x for x in plan if "Filter" in x]
    assert len(filters) >= 3 and not any("Base64" in x or "unbase64" in x for x in filters)


def test_records_keep_their_types(spark, sf_small):
    from progscan.sources import derived as D

    def bare(t):
        return t.simpleString()

    got = D.all_transactions(spark, sf_small).schema
    assert [(f.name, bare(f.dataType)) for f in got] == [(f.name, bare(f.dataType)) for f in D.TX_SCHEMA]


def test_little_endian_hex_of_any_long(spark):
    from progscan.functions.binary import le_hex

    values = [0, 1, -1, 255, 256, 0x0123456789ABCDEF, -0x0123456789ABCDEF, 2**63 - 1, -(2**63), None]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select(
        "v", *[le_hex(F.col("v"), n).alias(f"b{n}") for n in (1, 2, 4, 8)]).collect()
    for r in rows:
        for n in (1, 2, 4, 8):
            want = None if r.v is None else (r.v % 2**64).to_bytes(8, "little")[:n].hex().upper()
            assert r[f"b{n}"] == want
