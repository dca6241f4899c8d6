"""Event decoding from transaction logs (the reference's event cases)."""

import json

from helpers import b64, disc, u8, u64
from progscan.operators import ingest as I
from progscan.plans.idl import Idl
from progscan.sources.derived import TX_SCHEMA

IDL_EVENTS = Idl.from_dict({
    "name": "test_program", "instructions": [],
    "events": [
        {"name": "TradeExecuted", "fields": [{"name": "amount", "type": "u64"}, {"name": "price", "type": "u64"},
                                             {"name": "side", "type": "u8"}]},
        {"name": "LiquidityAdded", "fields": [{"name": "tokenA", "type": "u64"}, {"name": "tokenB", "type": "u64"}]},
    ],
})

TRADE = disc("event:", "TradeExecuted") + u64(1000) + u64(500) + u8(1)
LIQ = disc("event:", "LiquidityAdded") + u64(7) + u64(8)


def _tx(spark, logs_per_tx):
    rows = []
    for i, logs in enumerate(logs_per_tx):
        rows.append((f"sig{i}", 12345, 0, None, (None, logs, []), ((([]), []),)))
    return spark.createDataFrame(rows, TX_SCHEMA)


def _events(spark, logs, idl=IDL_EVENTS):
    return I.decode_events(_tx(spark, [logs]), idl).orderBy("id").collect()


def test_single_event_between_plain_logs(spark):
    out = _events(spark, ["Program log: start", "Program data: " + b64(TRADE), "Program log: end"])
    assert len(out) == 1
    r = out[0]
    assert r["event_name"] == "TradeExecuted" and r["slot"] == 12345 and r["signature"] == "sig0"
    assert json.loads(r["data"]) == {"amount": "1000", "price": "500", "side": 1}


def test_two_events_in_log_order(spark):
    out = _events(spark, ["Program data: " + b64(TRADE), "Program data: " + b64(LIQ)])
    assert [r["event_name"] for r in out] == ["TradeExecuted", "LiquidityAdded"]
    assert json.loads(out[1]["data"]) == {"tokenA": "7", "tokenB": "8"}


def test_noise_is_skipped_without_error(spark):
    assert _events(spark, ["Program log: a", "Program log: b"]) == []
    assert _events(spark, ["Program data: " + b64(b"\xff" * 8 + u64(1))]) == []
    assert _events(spark, ["Program data: !!!not-valid-base64!!!"]) == []
    assert _events(spark, ["Program data: " + b64(b"\x01\x02\x03\x04")]) == []


def test_idl_without_events(spark):
    idl = Idl.from_dict({"name": "x", "instructions": []})
    assert I.decode_events(_tx(spark, [["Program data: " + b64(TRADE)]]), idl).count() == 0


def test_failed_transaction_has_no_events(spark):
    rows = [("s", 1, 0, None, ('{"err":1}', ["Program data: " + b64(TRADE)], []), (([], []),))]
    tx = spark.createDataFrame(rows, TX_SCHEMA)
    assert I.decode_events(tx, IDL_EVENTS).count() == 0


def test_same_layout_events_keep_their_own_keys(spark):
    import struct

    from helpers import string

    idl = Idl.from_dict({"name": "p", "instructions": [], "events": [
        {"name": "A", "fields": [{"name": "memo", "type": "string"}, {"name": "x", "type": "u8"}]},
        {"name": "B", "fields": [{"name": "note", "type": "string"}, {"name": "y", "type": "u8"}]},
        {"name": "C", "fields": [{"name": "tags", "type": {"vec": "string"}}, {"name": "z", "type": "u8"}]},
    ]})
    a = disc("event:", "A") + string('"note"') + u8(1)
    b = disc("event:", "B") + string('{"memo":1}') + u8(2)
    c = disc("event:", "C") + struct.pack("<I", 2) + string("p") + string('q"') + u8(3)
    out = I.decode_events(_tx(spark, [["Program data: " + b64(x) for x in (a, b, c)]]), idl).orderBy("id").collect()
    assert [json.loads(r["data"]) for r in out] == [{"memo": '"note"', "x": 1}, {"note": '{"memo":1}', "y": 2},
                                                    {"tags": '["p","q\\""]', "z": 3}]


def test_definitions_without_fields(spark):
    idl = Idl.from_dict({"name": "p", "instructions": [{"name": "initialize", "accounts": [], "args": []}],
                         "events": [{"name": "Ping", "fields": []}]})
    out = I.decode_events(_tx(spark, [["Program data: " + b64(disc("event:", "Ping"))]]), idl).collect()
    assert [(r["event_name"], r["data"]) for r in out] == [("Ping", "{}")]
    rows = [("s", 1, 0, None, (None, [], []), (([("P", b64(disc("global:", "initialize")), None)], []),))]
    d = I.decode_instructions(spark.createDataFrame(rows, TX_SCHEMA), idl, "P").collect()
    assert [r["ix_name"] for r in d] == ["initialize"]
