"""Physical-plan properties the design relies on (checked on the executed plans)."""

import pytest

import __spark_entry__ as E

# zlib, base58 and items whose width is only known once they are read have no SQL form
PYTHON_OK = {"idl_extract", "decode_ix_base58", "decode_typed_mixed", "decode_vec_nested", "decode_vec_overrun"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


# several micro-batches each; what they return is a read of what they stored, which test_streaming covers
STORED = {"stream_gap_fill", "stream_dedup_compacted", "stream_late", "ix_evolved_read", "rollup_hour", "rollup_day",
          "acc_resync"}


class Jobs:
    """The library's own jobs, each built when first asked for."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self.names = [n for n in E.queries() if n not in E.LLM_QUERIES]

    def __getitem__(self, name):
        return E.queries()[name](self.spark, self.sf)

    def items(self):
        return ((n, self[n]) for n in self.names if n not in STORED)


@pytest.fixture(scope="module")
def jobs(spark, sf_small):
    return Jobs(spark, sf_small)


def test_no_cartesian_joins_and_python_only_where_declared(jobs):
    for name, df in jobs.items():
        p = _final_plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        uses_python = any(k in p for k in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas"))
        assert not uses_python or name in PYTHON_OK, name


def test_keyset_page_is_pruned_and_pushed(jobs):
    import re

    p = _final_plan(jobs["ix_page_next"])
    assert re.search(r"PartitionFilters: \[isnotnull\(ix_name#\d+\), \(ix_name#\d+ = click\)\]", p), p
    assert "GreaterThanOrEqual(slot,5000)" in p
    assert "TakeOrderedAndProject" in p


def test_aggregates_are_partial(jobs):
    for name in ("agg_sum_hour", "stats_instructions"):
        p = _final_plan(jobs[name])
        assert p.count("Aggregate") >= 2, name


def test_first_per_key_is_limited_before_the_shuffle(jobs):
    for name in ("acc_snapshot", "ix_dedup"):
        p = _final_plan(jobs[name])
        assert p.count("WindowGroupLimit") >= 2 and "SortAggregate" not in p, name


def test_ingest_reads_its_transactions_once(jobs):
    assert _final_plan(jobs["decode_ix"]).count("FileScan") == _final_plan(jobs["ix_all"]).count("FileScan")
    assert jobs["decode_ix"]._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_definition_join_is_broadcast(jobs):
    p = _final_plan(jobs["decode_ix"])
    assert "BroadcastHashJoin" in p


def test_account_scan_by_type_is_pushed(jobs):
    p = _final_plan(jobs["acc_scan_type"])
    assert "EqualTo(disc," in p


def _rows_scanned(df) -> int:
    """Rows that the executed plan's scans gave out, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if hasattr(plan, "finalPhysicalPlan") and "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.finalPhysicalPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_single_keys_skip_most_row_groups(spark, tmp_path):
    from pyspark.sql import functions as F

    from progscan.operators import store as S

    n = 40_000
    h = spark.range(n).select(F.concat(F.lit("k"), (F.col("id") % 500).cast("string")).alias("pubkey"),
                              F.col("id").alias("slot"), F.lit(0).cast("bigint").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    S.write_history(h, f"{tmp_path}/h", buckets=8, options={"parquet.block.size": "16384", "parquet.page.size": "4096"})
    got = S.history_of(spark.read.parquet(f"{tmp_path}/h"), "k77", buckets=8)
    assert sorted(r["slot"] for r in got.collect()) == list(range(77, n, 500))
    assert _rows_scanned(got) < n / 20
    assert S.history_of(spark.read.parquet(f"{tmp_path}/h"), "unknown", buckets=8).count() == 0
    # signatures in no order: only the Bloom filters tell row groups apart
    sigs = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("signature"), F.col("id").alias("slot"))
    S.with_bloom(sigs.coalesce(1).write, ["signature"]).option("parquet.block.size", "65536") \
        .option("parquet.page.size", "4096").option("parquet.bloom.filter.max.bytes", "16384").parquet(f"{tmp_path}/s")
    table = spark.read.parquet(f"{tmp_path}/s")
    wanted = [r["signature"] for r in sigs.where("slot IN (5, 30000)").collect()]
    got = S.by_signatures(table, wanted + ["nowhere"])
    assert sorted(r["slot"] for r in got.collect()) == [5, 30000]
    assert _rows_scanned(got) < n / 4
    many = [r["signature"] for r in sigs.where("slot < 200").collect()]
    assert S.by_signatures(table, many).count() == 200
