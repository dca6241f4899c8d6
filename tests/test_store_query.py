"""Write semantics and queries (the reference's repository cases), on small frames."""

import pytest

from helpers import b64, disc, u16, u64
from progscan.functions.codec import cursor_decode_py
from progscan.operators import accounts as A
from progscan.operators import ingest as I
from progscan.operators import quality as Qa
from progscan.operators import query as Q
from progscan.operators import store as S
from progscan.plans.idl import Idl
from progscan.sources.derived import TX_SCHEMA

IDL_SWAP = Idl.from_dict({
    "name": "test_prog",
    "instructions": [{"name": "swap",
                      "accounts": [{"name": "user", "isMut": True, "isSigner": True},
                                   {"name": "pool", "isMut": True, "isSigner": False}],
                      "args": [{"name": "amountIn", "type": "u64"}, {"name": "minOut", "type": "u64"}]}],
    "accounts": [{"name": "PoolState", "type": {"kind": "struct", "fields": [
        {"name": "totalLiquidity", "type": "u64"}, {"name": "fee", "type": "u16"}]}}],
})
PID = "Prog1111"


def _swap_tx(sig, slot, amount, user="7xKp", block_time=1711000000, err=None):
    data = b64(disc("global:", "swap") + u64(amount) + u64(1))
    return (sig, slot, 0, block_time, (err, [], []),
            (([(PID, data, None)], [(user,), ("pool1",)]),))


def _stored(spark, txs):
    tx = spark.createDataFrame(txs, TX_SCHEMA)
    d = I.decode_instructions(tx, IDL_SWAP, PID)
    order = ["slot", "id"] + [c for c in d.columns if c not in ("ix_name", "signature", "slot", "id")]
    return S.insert_ignore(d, ["ix_name", "signature"], order)


def test_insert_and_columns(spark):
    rows = _stored(spark, [_swap_tx("sig001", 300000000, 1000000)]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["arg_amountin"] == "1000000" and r["account_user"] == "7xKp" and r["account_pool"] == "pool1"
    assert r["block_time"] == 1711000000 and r["cpi_depth"] == 0 and r["parent_ix_index"] is None
    t = I.instruction_table(_stored(spark, [_swap_tx("sig001", 1, 5)]), IDL_SWAP, "swap")
    assert t.columns == ["id", "signature", "slot", "block_time", "cpi_depth", "parent_ix_index",
                         "account_user", "account_pool", "arg_amountin", "arg_minout"]


def test_duplicate_signature_ignored(spark):
    s = _stored(spark, [_swap_tx("dup_sig", 5, 1), _swap_tx("dup_sig", 5, 2)])
    assert s.count() == 1
    # against a stored table the second batch adds nothing
    again = S.insert_ignore(s, ["ix_name", "signature"], ["slot", "id"], existing=s)
    assert again.count() == 0


def test_failed_tx_skipped(spark):
    assert _stored(spark, [_swap_tx("x", 1, 1, err='{"e":1}')]).count() == 0


def test_slot_ranges(spark):
    s = _stored(spark, [_swap_tx(f"s{v}", v, v) for v in (100, 200, 300)])
    assert Q.slot_range(s, slot_from=200).count() == 2
    assert Q.slot_range(s, slot_to=200).count() == 2
    assert Q.slot_range(s, slot_from=0).count() == 3
    assert Q.slot_range(s, slot_from=0, zero_is_absent=True).count() == 3


def test_pages_and_cursor_walk(spark):
    one = _stored(spark, [_swap_tx("a", 1, 1)])
    p = Q.page(one, limit=10)
    assert p.rows.count() == 1 and p.next_cursor is None
    five = _stored(spark, [_swap_tx(f"s{i}", i, i) for i in range(5)])
    p = Q.page(five, limit=2)
    assert p.rows.count() == 2 and p.next_cursor is not None
    assert cursor_decode_py(p.next_cursor)[0] == 1
    seen, cursor = [], None
    while True:
        p = Q.page(five, limit=2, cursor=cursor)
        seen += [r["signature"] for r in p.rows.collect()]
        if not p.next_cursor:
            break
        cursor = p.next_cursor
    assert sorted(seen) == sorted(f"s{i}" for i in range(5)) and len(seen) == 5
    assert Q.page(five, limit=1000).rows.count() == 5
    assert cursor_decode_py("not-a-cursor") is None


def test_unsafe_filter_key_ignored(spark):
    s = _stored(spark, [_swap_tx("a", 1, 1), _swap_tx("b", 2, 2)])
    assert Q.equality_filters(s, {"DROP TABLE--": "x"}).count() == 2
    assert Q.equality_filters(s, {"arg_amountin": "2"}).count() == 1
    with pytest.raises(ValueError):
        Q.equality_filters(s, {"no_such_col": "1"})


def test_aggregates(spark):
    s = _stored(spark, [_swap_tx("a", 1, 500), _swap_tx("b", 2, 300)])
    t = lambda op, f=None: Q.aggregate(s, "total", op, f).first()
    assert t("count")["total_calls"] == 2
    assert t("sum", "arg_amountin")["value"] == 800
    s2 = _stored(spark, [_swap_tx("a", 1, 400), _swap_tx("b", 2, 600)])
    assert Q.aggregate(s2, "total", "avg", "arg_amountin").first()["value"] == 500
    s3 = _stored(spark, [_swap_tx("a", 1, 100), _swap_tx("b", 2, 900)])
    assert Q.aggregate(s3, "total", "min", "arg_amountin").first()["value"] == 100
    assert Q.aggregate(s3, "total", "max", "arg_amountin").first()["value"] == 900
    with pytest.raises(Q.UnsafeName):
        Q.aggregate(s3, "total", "sum", "DROP TABLE")


def test_hour_buckets_fall_back_to_slots(spark):
    s = _stored(spark, [_swap_tx("a", 9000, 1, block_time=None), _swap_tx("b", 18000, 1, block_time=None)])
    out = {r["bucket"]: r["count"] for r in Q.aggregate(s, "hour").collect()}
    assert out == {1: 1, 2: 1}


def test_stats_include_missing(spark):
    s = _stored(spark, [_swap_tx("a", 1, 1), _swap_tx("b", 2, 1)])
    r = {x["ix_name"]: x["total"] for x in Q.instruction_stats(s, ["swap", "other"]).collect()}
    assert r == {"swap": 2, "other": 0}


def _hist_rows(spark, rows):
    return spark.createDataFrame(rows, "pubkey string, slot bigint, seq bigint, liquidity string")


def test_snapshot_and_history(spark):
    h = _hist_rows(spark, [("p1", 100, 0, "5000"), ("p1", 200, 0, "6000"), ("p2", 50, 0, "1")])
    snap = {r["pubkey"]: r["liquidity"] for r in A.snapshot(h).collect()}
    assert snap == {"p1": "6000", "p2": "1"}
    h3 = _hist_rows(spark, [("k", s, 0, str(s)) for s in (100, 200, 300)]).withColumnRenamed("seq", "id")
    page = [r["slot"] for r in Q.history_page(h3, "k").collect()]
    assert page[0] == 300 and page[-1] == 100
    h10 = _hist_rows(spark, [("k", s, 0, "x") for s in range(10)]).withColumnRenamed("seq", "id")
    assert Q.history_page(h10, "k", limit=3).count() == 3
    assert Q.history_page(h10, "unknown").count() == 0


def test_as_of_and_changes(spark):
    h = _hist_rows(spark, [("p", 1, 0, "a"), ("p", 2, 0, "a"), ("p", 3, 0, "b"), ("p", 2500, 0, "b"),
                           ("p", 2600, 0, "c"), ("q", 5, 0, "z")])
    assert {r["pubkey"]: r["liquidity"] for r in A.as_of(h, 2).collect()} == {"p": "a"}
    assert {r["pubkey"]: r["liquidity"] for r in A.as_of(h, 5).collect()} == {"p": "b", "q": "z"}
    ch = sorted((r["pubkey"], r["slot"]) for r in A.changes(h, ["liquidity"], bucket_slots=1000).collect())
    assert ch == [("p", 1), ("p", 3), ("p", 2600), ("q", 5)]


def test_merge_present_keeps_old_columns(spark):
    h = spark.createDataFrame([("p", 1, 0, "a", "x"), ("p", 2, 0, None, "y")],
                              "pubkey string, slot bigint, seq bigint, c1 string, c2 string")
    r = S.merge_present(h, ["pubkey"], ["slot", "seq"], ["c1", "c2"]).first()
    assert (r["c1"], r["c2"], r["slot"]) == ("a", "y", 2)


def test_checkpoint(spark):
    empty = spark.createDataFrame([], "slot bigint")
    assert S.checkpoint_max(empty).first()[0] == 0
    assert S.checkpoint_max(spark.createDataFrame([(12345,)], "slot bigint")).first()[0] == 12345
    assert S.checkpoint_max(spark.createDataFrame([(5,)], "slot bigint"), previous=9).first()[0] == 9


def test_histogram_default_bounds(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (1.0,)], "x double")
    rows = Qa.histogram(df, "x", Qa.DEFAULT_BOUNDS).collect()
    buckets = [r["value"] for r in rows if r["series"] == "bucket"]
    assert buckets == [0, 0, 0, 0, 1, 2, 3, 3, 3]
    assert [r["value"] for r in rows if r["series"] == "count"] == [3]


def test_gaps_by_slot_and_signature(spark):
    listing = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "signature string, slot bigint")
    seen = spark.createDataFrame([("a", 1)], "signature string, slot bigint")
    assert sorted(r["signature"] for r in Qa.gaps(listing, seen, "slot").collect()) == ["c"]
    assert sorted(r["signature"] for r in Qa.gaps(listing, seen, "signature").collect()) == ["b", "c"]


def test_account_decode_by_type(spark):
    data = disc("account:", "PoolState") + u64(6000) + u16(30)
    other = disc("account:", "Other") + u64(1)
    acc = spark.createDataFrame([("p1", data, 7), ("p2", other, 8), ("p3", b"\x01", 9)],
                                "pubkey string, data binary, slot bigint")
    d = I.decode_accounts(acc, IDL_SWAP).collect()
    assert len(d) == 1 and d[0]["totalliquidity"] == "6000" and d[0]["fee"] == "30"
    assert A.scan_type(acc, "PoolState").count() == 1
    assert A.scan_type(A.with_disc(acc), "PoolState").count() == 1


def test_aggregate_options(spark):
    s = _stored(spark, [_swap_tx("a", 9000, 2 ** 60, block_time=None), _swap_tx("b", 18000, 3, block_time=7200),
                        _swap_tx("c", 18001, 2 ** 60 + 1, block_time=7300)])
    rows = {(r["bucket"], r["basis"]): r["count"] for r in Q.aggregate(s, "hour", bucket_basis=True).collect()}
    assert rows == {(1, "slot"): 1, (2, "time"): 2}
    exact = Q.aggregate(s, "total", "sum", "arg_amountin", numeric_type="decimal").first()["value"]
    assert int(exact) == 2 ** 61 + 4  # a double sum would lose the low bits


def test_since_checkpoint_and_poll(spark):
    from progscan.sources import transactions as X

    tx = spark.createDataFrame([_swap_tx(f"s{i}", i, 1) for i in range(1, 301)], TX_SCHEMA)
    assert X.since_checkpoint(tx, 100).count() == 200
    capped = X.since_checkpoint(tx, 0, max_rows=200)
    assert [r["slot"] for r in capped.collect()] == list(range(101, 301))  # newest 200, oldest first
    polled = [r["slot"] for r in X.poll_latest(tx, 290).collect()]
    assert polled == list(range(291, 301))  # newest 20 listed, then above the checkpoint
    assert [r["slot"] for r in X.poll_latest(tx, 0, listed=5).collect()] == list(range(296, 301))


def test_positions_beyond_the_radix_share_the_last_place(spark):
    one = _swap_tx("many", 7, 5)
    ix = one[5][0][0] * (I.POS_RADIX + 5)
    tx = spark.createDataFrame([(*one[:5], ((ix, one[5][0][1]),))], TX_SCHEMA)
    d = I.decode_instructions(tx, IDL_SWAP, PID)
    assert d.count() == I.POS_RADIX + 5 and d.select("id").distinct().count() == I.POS_RADIX
    assert S.insert_ignore(d, ["ix_name", "signature"], ["slot", "id"]).first()["id"] == 0
