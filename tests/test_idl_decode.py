"""IDL names, discriminators, argument decode (the reference's asserted values)."""

from pyspark.sql import functions as F

from helpers import disc, string, u64
from progscan.functions.codec import (
    DISC_PREFIX_INSTRUCTION, discriminator_hex, discriminator_py, normalise_name_py, table_name_py,
)
from progscan.operators import ingest as I
from progscan.plans.decode import decode_fields
from progscan.operators.versions import storage_type
from progscan.plans.idl import Field, Idl

IDL_TRANSFER = {
    "name": "test_program",
    "instructions": [
        {"name": "transfer", "accounts": [{"name": "from", "isMut": True, "isSigner": True},
                                          {"name": "to", "isMut": True, "isSigner": False}],
         "args": [{"name": "amount", "type": "u64"}, {"name": "memo", "type": "string"}]},
        {"name": "initialize", "accounts": [{"name": "authority", "isMut": True, "isSigner": True}], "args": []},
    ],
}


def test_discriminator_known_value(spark):
    assert discriminator_py(DISC_PREFIX_INSTRUCTION, "transfer") == "a334c8e78c0345ba"
    got = spark.range(1).select(discriminator_hex(DISC_PREFIX_INSTRUCTION, "transfer").alias("d")).first()["d"]
    assert got == "a334c8e78c0345ba"
    assert discriminator_py(DISC_PREFIX_INSTRUCTION, "initialize") != got


def test_table_names():
    assert table_name_py("ix", "myProgram", "myInstruction") == "ix_myprogram_myinstruction"
    assert table_name_py("ix", "my-program", "my-ix") == "ix_my_program_my_ix"
    assert normalise_name_py("A b-C") == "a_b_c"


def test_storage_types(spark):
    of = {"bool": "INTEGER", "u64": "TEXT", "u32": "INTEGER", "f64": "INTEGER", "i128": "TEXT", "publicKey": "TEXT",
          "string": "TEXT", '{"option":"u64"}': "TEXT", '{"option":"u16"}': "INTEGER", '{"vec":"u8"}': "TEXT",
          '{"option":{"option":"i8"}}': "INTEGER", '{"option":{"vec":"u8"}}': "TEXT", '{"defined":"Side"}': "TEXT",
          '{"option":{"defined":"u8"}}': "TEXT", '{"array":["u8",4]}': "TEXT"}
    rows = spark.createDataFrame([(t,) for t in of], "t string").select("t", storage_type(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == of


def test_match_and_decode(spark):
    idl = Idl.from_dict(IDL_TRANSFER)
    rows = [
        ("a", (disc("global:", "transfer") + bytes(16)).hex()),
        ("b", bytes(16).hex()),
        ("c", bytes(4).hex()),
        ("d", (disc("global:", "transfer") + u64(1000) + string("hello")).hex()),
    ]
    df = spark.createDataFrame(rows, "k string, h string").withColumn("data", F.base64(F.unhex("h")))
    defs = I.definitions(spark, idl.instruction_discriminators())
    m = I.match_definitions(df, F.col("data"), defs, "ix_name")
    got = {r["k"]: r["ix_name"] for r in m.collect()}
    assert got == {"a": "transfer", "d": "transfer"}
    dec = decode_fields(m, "raw", list(idl.instruction("transfer").args), ["amount", "memo"])
    d = {r["k"]: (r["amount"], r["memo"]) for r in dec.collect()}
    assert d["d"] == ("1000", "hello")
    # 16 zero bytes after the discriminator: amount 0, memo of length 0
    assert d["a"] == ("0", "")


def test_u64_and_truncation(spark):
    rows = [(bytes(8) + u64(1000),), (bytes(4),), (bytes(8) + u64(2 ** 64 - 1),), (bytes(8) + b"\x01\x02",)]
    df = spark.createDataFrame(rows, "raw binary")
    out = decode_fields(df, "raw", [Field("v", "u64")], ["v"]).collect()
    assert [r["v"] for r in out] == ["1000", None, "18446744073709551615", None]


def test_failed_field_does_not_advance(spark):
    # u64 needs 8 bytes but only 4 follow: NULL, and the u16 reads at the same offset
    df = spark.createDataFrame([(bytes(8) + bytes([7, 0, 9, 9]),)], "raw binary")
    out = decode_fields(df, "raw", [Field("a", "u64"), Field("b", "u16")], ["a", "b"]).first()
    assert out["a"] is None and out["b"] == "7"


def test_string_overrun_keeps_offset(spark):
    payload = bytes(8) + (1000).to_bytes(4, "little") + b"abc"
    df = spark.createDataFrame([(payload,)], "raw binary")
    out = decode_fields(df, "raw", [Field("s", "string"), Field("n", "u32")], ["s", "n"]).first()
    assert out["s"] is None and out["n"] == "1000"
