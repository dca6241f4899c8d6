"""The streams' source files and the one search of the archive in a gap fill."""

import glob

from pyspark.sql import functions as F

from progscan.jobs import _base as B
from progscan.jobs import stream_jobs as J
from progscan.session import scratch_dir
from progscan.streaming import pipelines as P


def test_source_files_hold_whole_slots(spark, sf_small, monkeypatch):
    monkeypatch.setattr(J, "SOURCE_BYTES", 10_000)  # a larger input has more files
    src = scratch_dir(spark, "source").replace("file:", "")
    J._write_source(spark, sf_small, src)
    rows = spark.read.parquet(src).withColumn("file", F.input_file_name()).withColumn("kind", F.substring("signature", 1, 2))
    assert rows.groupBy("kind", "slot").agg(F.count_distinct("file").alias("n")).where("n > 1").isEmpty()
    assert len(glob.glob(f"{src}/part-*")) > J.FILES
    assert rows.count() == B.transactions(spark, sf_small).count()


def test_archive_is_read_once_in_a_fill(spark, sf_small):
    sink = f"{scratch_dir(spark, 'fill_once')}/sink"
    tx = B.activity_transactions(spark, sf_small).where("slot < 400")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(signature):
        read.add(1)
        return signature

    archive = tx.withColumn("signature", noted.asNondeterministic()("signature"))
    P.process_transactions(tx.where("slot % 5 != 0"), 0, sink, B.IDL, B.PID, listing=tx.select("signature", "slot"),
                           gap_every=1, gap_requires_progress=False, archive=archive)
    assert read.value == tx.count()
    whole = P.read_stored(spark, sink).select("signature")
    assert whole.count() == tx.where("meta.err IS NULL").count()
