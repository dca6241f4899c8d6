from progscan.operators.ingest import program_instructions
from progscan.sources.derived import TX_SCHEMA
from pyspark.sql import functions as F


def test_null_instruction_arrays_lose_only_themselves(spark):
    """A null group, or null top-level instructions, beside groups that have rows."""
    tx = spark.createDataFrame([("s1",), ("s2",)], "signature string").select(
        *[(F.col("signature") if f.name == "signature" else F.lit(None).cast(f.dataType)).alias(f.name)
          for f in spark.createDataFrame([], TX_SCHEMA).schema.fields])
    meta = dict(tx.dtypes)["meta"]
    top = dict(tx.dtypes)["transaction"]
    rows = tx.withColumn("meta", F.from_json(F.lit(
        '{"innerInstructions":[{"index":0,"instructions":null},{"index":1,"instructions":[{"programId":"P","data":"x"}]}]}'),
        meta))
    rows = rows.withColumn("transaction", F.when(F.col("signature") == "s1", F.from_json(F.lit(
        '{"message":{"accountKeys":[],"instructions":null}}'), top)).otherwise(F.from_json(F.lit(
            '{"message":{"accountKeys":[],"instructions":[{"programId":"P","data":"y"}]}}'), top)))
    got = sorted((r.signature, r.cpi_depth, r.data) for r in program_instructions(rows, "P").collect())
    assert got == [("s1:cpi:1", 1, "x"), ("s2", 0, "y"), ("s2:cpi:1", 1, "x")]
