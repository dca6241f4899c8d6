"""Parity options and the Arrow paths: base58 payloads, snake_case names, IDL accounts, typed tables."""

import json
import struct
import zlib


from helpers import disc, u64
from progscan.functions import base58
from progscan.operators import ingest as I
from progscan.plans.idl import Idl, snake_case
from progscan.sources.derived import TX_SCHEMA
from progscan.sources.idl_accounts import extract_idl

IDL = Idl.from_dict({"name": "p", "instructions": [
    {"name": "swapExact", "accounts": [{"name": "user"}], "args": [{"name": "amount", "type": "u64"}]}]})


def _tx(spark, data):
    return spark.createDataFrame([("s1", 5, 0, None, (None, [], []), (([("P", data, None)], [("k1",)]),))],
                                 TX_SCHEMA)


def test_base58_roundtrip():
    for b in [b"", b"\x00\x00\x01", bytes(range(40)), b"\xff" * 9]:
        assert base58.decode_py(base58.encode_py(b)) == b
    assert base58.decode_py("0OIl") is None


def test_base58_payloads(spark):
    payload = disc("global:", "swapExact") + u64(77)
    out = I.decode_instructions(_tx(spark, base58.encode_py(payload)), IDL, "P", encoding="base58").collect()
    assert [(r["ix_name"], r["arg_amount"]) for r in out] == [("swapExact", "77")]


def test_snake_case_discriminator(spark):
    assert snake_case("swapExact") == "swap_exact"
    import base64

    payload = disc("global:", "swap_exact") + u64(5)
    data = base64.b64encode(payload).decode()
    assert I.decode_instructions(_tx(spark, data), IDL, "P").count() == 0
    out = I.decode_instructions(_tx(spark, data), IDL, "P", name_case="snake").collect()
    assert out[0]["arg_amount"] == "5"


def _idl_account(body: bytes) -> bytes:
    return b"\x01" * 8 + b"\x02" * 32 + struct.pack("<I", len(body)) + body


def test_extract_idl_zlib_and_plain(spark):
    doc = json.dumps({"name": "x", "instructions": []})
    rows = [("zip", _idl_account(zlib.compress(doc.encode()))), ("plain", _idl_account(doc.encode())),
            ("short", b"\x00" * 43), ("junk", _idl_account(b"\x00\x01garbage"))]
    acc = spark.createDataFrame(rows, "program_id string, data binary")
    got = {r["program_id"]: r["idl_json"] for r in extract_idl(acc).collect()}
    assert got == {"zip": doc, "plain": doc}


def test_typed_table(spark):
    idl = Idl.from_dict({"name": "p", "instructions": [
        {"name": "t", "accounts": [], "args": [{"name": "a", "type": "u64"}, {"name": "f", "type": "bool"},
                                               {"name": "v", "type": {"vec": "u16"}}]}]})
    payload = disc("global:", "t") + u64(2 ** 64 - 1) + b"\x01" + struct.pack("<IHH", 2, 3, 4)
    import base64

    d = I.decode_instructions(_tx(spark, base64.b64encode(payload).decode()), idl, "P")
    r = I.instruction_table(d, idl, "t", mode="typed").first()
    assert int(r["arg_a"]) == 2 ** 64 - 1 and r["arg_f"] is True and r["arg_v"] == [3, 4]


IDL_DESK = Idl.from_dict({
    "name": "desk",
    "instructions": [{"name": "place", "accounts": [{"name": "user"}],
                      "args": [{"name": "hops", "type": {"vec": {"defined": "Hop"}}},
                               {"name": "total", "type": "u64"}, {"name": "limit", "type": "u16"}]}],
    "types": [{"name": "Hop", "type": {"kind": "struct", "fields": [
        {"name": "pool", "type": "publicKey"}, {"name": "weight", "type": "u32"}, {"name": "label", "type": "string"},
        {"name": "side", "type": {"defined": "Side"}}]}},
              {"name": "Side", "type": {"kind": "enum", "variants": [{"name": "Bid"}, {"name": "Ask"}]}}],
})


def test_defined_stored_parity_and_typed(spark):
    import base64

    hop = lambda i: bytes([i]) * 32 + struct.pack("<II", 1000 * i, 2) + b"h%d" % i + bytes([i % 2])
    payload = disc("global:", "place") + struct.pack("<I", 2) + hop(1) + hop(2) + u64(123456) + struct.pack("<H", 50)
    tx = _tx(spark, base64.b64encode(payload).decode())
    stored = I.decode_instructions(tx, IDL_DESK, "P").first()
    # stored mode reproduces the reference: NULL items consume nothing, later args misread (Q-4)
    assert stored["arg_hops"] == "[null,null]"
    assert stored["arg_total"] == str(struct.unpack("<Q", hop(1)[:8])[0])
    d = I.decode_instructions(tx, IDL_DESK, "P", mode="typed")
    r = I.instruction_table(d, IDL_DESK, "place", mode="typed").first()
    assert int(r["arg_total"]) == 123456 and r["arg_limit"] == 50
    assert [(h["weight"], h["label"], h["side"]) for h in r["arg_hops"]] == [(1000, "h1", "Ask"), (2000, "h2", "Bid")]
    assert base64.b64decode(r["arg_hops"][0]["pool"]) == bytes([1]) * 32
    # strict: a truncated list fails the field, and nothing after it is read
    short = disc("global:", "place") + struct.pack("<I", 3) + hop(1) + hop(2) + u64(9)
    d2 = I.decode_instructions(_tx(spark, base64.b64encode(short).decode()), IDL_DESK, "P", mode="typed").first()
    assert d2["arg_hops"] is None and d2["arg_total"] is None and d2["arg_limit"] is None


def test_typed_mode_never_misreads(spark):
    """One field that needs the batch reader does not take the registry from the others."""
    from progscan.plans.decode import decode_fields
    from progscan.plans.idl import Field

    types = Idl.from_dict({"name": "x", "instructions": [], "types": [
        {"name": "S", "type": {"kind": "struct", "fields": [{"name": "a", "type": "u8"}]}},
        {"name": "Loop", "type": {"kind": "struct", "fields": [{"name": "l", "type": {"vec": {"defined": "Loop"}}}]}}]}).type_def
    raw = bytes(8) + struct.pack("<II", 1, 2) + b"hi" + bytes([5]) + u64(1000)
    df = spark.createDataFrame([(raw,)], "raw binary")
    fields = [Field("v", {"vec": "string"}), Field("s", {"defined": "S"}), Field("n", "u64")]
    r = decode_fields(df, "raw", fields, ["v", "s", "n"], registry=types).first()
    assert (r["v"], r["s"], r["n"]) == ('["hi"]', '{"a":5}', "1000")
    import pytest

    for name, what in (("Nowhere", "not defined"), ("Loop", "holds itself")):
        with pytest.raises(ValueError, match=what):
            decode_fields(df, "raw", [Field("s", {"defined": name})], ["s"], registry=types)


def test_typed_event_account_tables_and_schema(spark):
    from pyspark.sql import types as T

    from progscan.jobs import _base as B
    from progscan.plans.decode import instruction_table_schema

    ev = I.event_table(B.events(spark, "/root/testdata/sf0.001"), B.IDL, "PurchaseMade", mode="typed")
    r = ev.first()
    assert isinstance(r["data"]["amount"], str) and r["data"]["memo"].startswith("order-")
    acc = I.decode_accounts(B.raw_accounts(spark, "/root/testdata/sf0.001"), B.IDL)
    sup = I.account_table(acc, B.IDL, "Supplier", mode="typed")
    assert sup.columns == ["pubkey", "slot", "suppkey", "nationkey", "balance"]
    assert sup.schema["balance"].dataType == T.LongType() and sup.count() > 0
    sch = instruction_table_schema(B.IDL, "settle", mode="typed")
    assert [f.name for f in sch.fields][-3:] == ["arg_quantity", "arg_price", "arg_discount"]
    assert sch["arg_quantity"].dataType == T.DecimalType(20, 0)
    stored = B.ix_table(spark, "/root/testdata/sf0.001", "settle")
    assert [f.name for f in instruction_table_schema(B.IDL, "settle").fields] == stored.columns


def test_many_layouts_decode_in_groups(spark):
    import base64

    types = ["u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64", "bool", "string"]
    ixs = [{"name": f"ix{i}", "accounts": [{"name": "a"}],
            "args": [{"name": f"f{j}", "type": types[(i + j) % len(types)]} for j in range(1 + i % 4)]}
           for i in range(16)]
    idl = Idl.from_dict({"name": "wide", "instructions": ixs})
    import random

    rnd = random.Random(11)
    rows = []
    for k in range(160):
        ix = ixs[k % 16]
        payload = disc("global:", ix["name"]) + rnd.randbytes(rnd.randrange(0, 30))
        rows.append((f"s{k}", k, 0, None, (None, [], []),
                     (([("P", base64.b64encode(payload).decode(), None)], [("k",)]),)))
    tx = spark.createDataFrame(rows, TX_SCHEMA)
    one = I.decode_instructions(tx, idl, "P", max_layouts=1000)
    grouped = I.decode_instructions(tx, idl, "P", max_layouts=4)
    cols = sorted(one.columns)
    assert sorted(grouped.columns) == cols
    norm = lambda df: sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())
    assert norm(one) == norm(grouped) and len(norm(one)) == 160


def test_account_schema_tables_and_evolution(spark):
    from progscan.operators import versions as V

    def doc(fields):
        return json.dumps({"name": "prog", "instructions": [],
                           "accounts": [{"name": "PoolState", "type": {"kind": "struct", "fields": fields}}]})

    v1 = doc([{"name": "totalLiquidity", "type": "u64"}, {"name": "fee", "type": "u16"}])
    v2 = doc([{"name": "totalLiquidity", "type": "u64"}, {"name": "fee", "type": "u16"},
              {"name": "owner", "type": "publicKey"}])
    docs = spark.createDataFrame([("p", 1, v1), ("p", 5, v2)], "program_id string, slot bigint, idl_json string")
    t = V.account_schema_tables(docs.where("slot = 1")).orderBy("ordinal").collect()
    assert [(r["column_name"], r["storage_type"]) for r in t] == [
        ("id", "INTEGER"), ("pubkey", "TEXT"), ("slot", "INTEGER"), ("totalliquidity", "TEXT"),
        ("fee", "INTEGER"), ("updated_at", "INTEGER")]
    ev = {r["column_name"]: r["first_slot"] for r in V.evolve(V.register(docs)).collect()
          if r["table_name"] == "acc_prog_poolstate"}
    assert ev["owner"] == 5 and ev["fee"] == 1
