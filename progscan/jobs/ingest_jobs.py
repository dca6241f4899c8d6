"""Jobs: scans (A-1..5), instruction/event ingest (D-*, C-1..4, B-1..3, B-9, H-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from progscan.functions.binary import le_hex
from progscan.functions.codec import DISC_PREFIX_EVENT, EVENT_LOG_PREFIX, discriminator_hex
from progscan.jobs._base import (
    ACT, ACT_IX_HEX, EV, IDL, IX_ACT, IX_ALL, IX_STL_ALL, PID, STL, STL_IX_HEX1, STL_IX_HEX2, TX, decode_events,
    decoded, ix_table, job,
    sql_b64, sql_le_hex, sql_str_hex, stored, transactions,
)
from progscan.operators import ingest as I
from progscan.operators import store as S
from progscan.session import scratch_dir
from progscan.sources import derived as D
from progscan.sources import transactions as X

SCAN_FROM, SCAN_TO = 3000, 6000
CHECKPOINT = 9000
JSON_LINES_PER_FILE = 500_000


@job("tx_scan", f"SELECT * FROM ({TX}) t")
def tx_scan(spark, sf):
    """A-1: every transaction row that has a body."""
    return X.flat(X.scan(transactions(spark, sf)))


@job("tx_slot_range", f"SELECT * FROM ({TX}) t WHERE slot BETWEEN {SCAN_FROM} AND {SCAN_TO}")
def tx_slot_range(spark, sf):
    """A-2 / J-2: inclusive slot range (batch mode)."""
    return X.flat(X.slot_range(X.scan(transactions(spark, sf)), SCAN_FROM, SCAN_TO))


_URGENT = ("SELECT 'st' || CAST(o_orderkey AS VARCHAR) || '_1' AS signature FROM orders "
           "WHERE o_orderpriority = '1-URGENT'")


@job("tx_by_signature", f"SELECT * FROM ({TX}) t WHERE signature IN ({_URGENT})")
def tx_by_signature(spark, sf):
    """A-3 / H-3: fetch the listed signatures (first line of every urgent order)."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    sigs = o.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.concat(F.lit("st"), F.col("o_orderkey").cast("string"), F.lit("_1")).alias("signature"))
    return X.flat(X.by_signatures(X.scan(transactions(spark, sf)), sigs))


@job("tx_incremental", f"SELECT * FROM ({TX}) t WHERE slot > {CHECKPOINT}")
def tx_incremental(spark, sf):
    """A-4 / G-6: everything above the checkpoint, oldest first, uncapped (Q-14 fixed)."""
    return X.flat(X.since_checkpoint(X.scan(transactions(spark, sf)), CHECKPOINT))


@job("tx_poll_latest",
     f"SELECT * FROM (SELECT * FROM ({TX}) t ORDER BY slot DESC, tx_index DESC, signature DESC LIMIT 20) x "
     f"WHERE slot > {CHECKPOINT}")
def tx_poll_latest(spark, sf):
    """A-5: newest 20 listed, then ``slot > checkpoint`` (limit before filter)."""
    return X.flat(X.poll_latest(X.scan(transactions(spark, sf)), CHECKPOINT))


@job("tx_ok_filter", f"SELECT * FROM ({TX}) t WHERE ok")
def tx_ok_filter(spark, sf):
    """C-1: failed transactions (``meta.err``) are skipped."""
    return X.flat(I.ok_transactions(X.scan(transactions(spark, sf))))


# ------------------------------------------------------------ instructions --

_TOP_SQL = f"""
SELECT signature, slot, CAST(4096 AS BIGINT) AS id, 0 AS cpi_depth, CAST(NULL AS INTEGER) AS parent_ix_index,
       {sql_b64(ACT_IX_HEX)} AS data
FROM ({ACT}) a WHERE event_type <> 'error'"""


@job("ix_top_level", _TOP_SQL)
def ix_top_level(spark, sf):
    """D-1 + C-2: top-level instructions of the program (depth 0, no parent)."""
    t = I.top_level_instructions(I.ok_transactions(transactions(spark, sf)), PID)
    return t.select("signature", "slot", "id", "cpi_depth", "parent_ix_index", "data")


_INNER_SQL = f"""
SELECT signature || ':cpi:0' AS signature, slot, ((CAST(tx_index AS BIGINT) * 2 + 1) * 4096) * 4096 AS id,
       1 AS cpi_depth, 0 AS parent_ix_index, {sql_b64(STL_IX_HEX1)} AS data
FROM ({STL}) s WHERE l_returnflag <> 'R'
UNION ALL
SELECT signature || ':cpi:0', slot, ((CAST(tx_index AS BIGINT) * 2 + 1) * 4096) * 4096 + 1, 1, 0,
       {sql_b64(STL_IX_HEX2)}
FROM ({STL}) s WHERE l_returnflag <> 'R'"""


@job("ix_inner", _INNER_SQL)
def ix_inner(spark, sf):
    """D-2: inner (CPI) instructions, ``sig:cpi:<index>``, depth 1, parent index."""
    t = I.inner_instructions(I.ok_transactions(transactions(spark, sf)), PID)
    return t.select("signature", "slot", "id", "cpi_depth", "parent_ix_index", "data")


@job("ix_all", f"SELECT signature, slot, id, cpi_depth, parent_ix_index FROM ({_TOP_SQL} UNION ALL {_INNER_SQL}) u")
def ix_all(spark, sf):
    """H-4: top-level and inner rows in one frame."""
    return I.program_instructions(transactions(spark, sf), PID).select(
        "signature", "slot", "id", "cpi_depth", "parent_ix_index")


_DECODED_SQL = f"""
SELECT ix_name, signature, account_user, account_authority, account_order, account_supplier,
       arg_amount, arg_k, arg_userid, arg_quantity, arg_price, arg_discount FROM ({IX_ACT}) a
UNION ALL
SELECT 'settle', signature || ':cpi:0', NULL, NULL, 'o' || CAST(l_orderkey AS VARCHAR),
       's' || CAST(l_suppkey AS VARCHAR), NULL, NULL, NULL, CAST(quantity AS VARCHAR), CAST(price AS VARCHAR),
       CAST(discount AS VARCHAR)
FROM ({STL}) s WHERE l_returnflag <> 'R'
UNION ALL
SELECT 'settle', signature || ':cpi:0', NULL, NULL, 'o' || CAST(l_orderkey AS VARCHAR),
       's' || CAST(l_suppkey AS VARCHAR), NULL, NULL, NULL, '0', CAST(tax AS VARCHAR), '0'
FROM ({STL}) s WHERE l_returnflag <> 'R'"""

_DECODED_COLS = ["ix_name", "signature", "account_user", "account_authority", "account_order", "account_supplier",
                 "arg_amount", "arg_k", "arg_userid", "arg_quantity", "arg_price", "arg_discount"]


@job("decode_ix", _DECODED_SQL)
def decode_ix(spark, sf):
    """E-4 + E-19 + D-5: discriminator match and argument decode, all types in one pass."""
    return decoded(spark, sf).select(*_DECODED_COLS)


@job("ix_accounts",
     f"SELECT ix_name, signature, account_user, account_authority, account_order, account_supplier "
     f"FROM ({_DECODED_SQL}) d")
def ix_accounts(spark, sf):
    """D-4: i-th IDL account <- i-th transaction-level key (Q-2 parity)."""
    return decoded(spark, sf).select("ix_name", "signature", "account_user", "account_authority",
                                     "account_order", "account_supplier")


_PROGRAM_SQL = f"""
SELECT program_id, cpi_depth, COUNT(*) AS n FROM (
  SELECT '{D.BUDGET_ID}' AS program_id, 0 AS cpi_depth FROM ({ACT}) a WHERE event_type <> 'error'
  UNION ALL SELECT '{PID}', 0 FROM ({ACT}) a WHERE event_type <> 'error'
  UNION ALL SELECT '{D.ROUTER_ID}', 0 FROM ({STL}) s WHERE l_returnflag <> 'R'
  UNION ALL SELECT '{PID}', 1 FROM ({STL}) s WHERE l_returnflag <> 'R'
  UNION ALL SELECT '{PID}', 1 FROM ({STL}) s WHERE l_returnflag <> 'R'
) x GROUP BY program_id, cpi_depth"""


@job("ix_program_filter", _PROGRAM_SQL)
def ix_program_filter(spark, sf):
    """C-2: rows kept per program id and depth (exact id, non-empty data)."""
    ok = I.ok_transactions(transactions(spark, sf))
    progs = [D.BUDGET_ID, PID, D.ROUTER_ID]
    top = ok.select(F.explode("transaction.message.instructions").alias("ix"), F.lit(0).alias("cpi_depth"))
    inner = ok.select(F.explode("meta.innerInstructions").alias("g")).select(
        F.explode("g.instructions").alias("ix"), F.lit(1).alias("cpi_depth"))
    u = top.select(F.col("ix.programId").alias("program_id"), F.col("ix.data").alias("data"), "cpi_depth") \
        .unionByName(inner.select(F.col("ix.programId").alias("program_id"), F.col("ix.data").alias("data"),
                                  "cpi_depth"))
    u = u.where(F.col("program_id").isin(progs) & (F.col("data") != ""))
    return u.groupBy("program_id", "cpi_depth").agg(F.count(F.lit(1)).alias("n"))


_FANOUT_SQL = f"""
SELECT n.table_name, COALESCE(c.n_rows, 0) AS n_rows FROM
 (VALUES {", ".join(f"('{IDL.instruction_table(ix.name)}', '{ix.name}')" for ix in IDL.instructions)}) n(table_name, ix_name)
LEFT JOIN (SELECT ix_name, COUNT(*) AS n_rows FROM {IX_ALL} x GROUP BY ix_name) c ON n.ix_name = c.ix_name"""


@job("ix_fanout", _FANOUT_SQL)
def ix_fanout(spark, sf):
    """D-6: one stored table per instruction type (row count of each)."""
    s = stored(spark, sf)
    agg = s.groupBy("ix_name").agg(F.count(F.lit(1)).alias("n_rows"))
    names = spark.createDataFrame([(IDL.instruction_table(ix.name), ix.name) for ix in IDL.instructions],
                                  "table_name string, ix_name string")
    return names.join(agg, "ix_name", "left").select(
        "table_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


_SETTLE_COLS = ["id", "signature", "slot", "block_time", "cpi_depth", "parent_ix_index", "account_order",
                "account_supplier", "arg_quantity", "arg_price", "arg_discount"]


@job("ix_dedup",
     f"SELECT {', '.join(_SETTLE_COLS)} FROM {IX_ALL} x WHERE ix_name = 'settle' AND slot >= {CHECKPOINT}")
def ix_dedup(spark, sf):
    """B-1 / H-6: insert-or-ignore of a batch against a stored table.

    The stored table holds slots below the checkpoint; the batch is everything
    decoded (replays and CPI siblings included). The rows appended are the
    first per signature that were not stored yet.
    """
    d = decoded(spark, sf).where(F.col("ix_name") == "settle")
    order = ["slot", "id"] + [c for c in d.columns if c not in ("ix_name", "signature", "slot", "id")]
    # what an earlier run stored: the stored table below the checkpoint (read, not recomputed)
    existing = stored(spark, sf, ["settle"]).where((F.col("ix_name") == "settle") & (F.col("slot") < CHECKPOINT))
    new = S.insert_ignore(d, ["ix_name", "signature"], order, existing=existing)
    return new.select(*_SETTLE_COLS)


@job("ix_stored_text",
     "SELECT CAST(id AS VARCHAR) AS id, signature, CAST(slot AS VARCHAR) AS slot, "
     "CAST(block_time AS VARCHAR) AS block_time, CAST(cpi_depth AS VARCHAR) AS cpi_depth, "
     "CAST(parent_ix_index AS VARCHAR) AS parent_ix_index, account_user, account_authority, arg_amount, arg_k, "
     f"arg_userid FROM {IX_ALL} x WHERE ix_name = 'purchase'")
def ix_stored_text(spark, sf):
    """B-9 / E-21: every value as the stored text ``String(v)`` (NULL stays NULL)."""
    t = ix_table(spark, sf, "purchase")
    return S.stored_text(t)


# ------------------------------------------------------------------ events --

_VALUE_HEX = (f"(substr(sha256('event:ValueRecorded'), 1, 16) || {sql_le_hex('amount', 8)} "
              f"|| {sql_le_hex('user_id', 4)} || {sql_le_hex('k', 2)})")
_PURCHASE_HEX = (f"(substr(sha256('event:PurchaseMade'), 1, 16) || {sql_le_hex('amount', 8)} "
                 f"|| {sql_str_hex(chr(39) + 'order-' + chr(39) + ' || CAST(k AS VARCHAR)')})")

_LOG_SQL = f"""
SELECT signature, 2 AS pos, {sql_b64(_VALUE_HEX)} AS payload
FROM ({ACT}) a WHERE event_type <> 'error'
UNION ALL
SELECT signature, 3, {sql_b64(_PURCHASE_HEX)}
FROM ({ACT}) a WHERE event_type = 'purchase'
UNION ALL
SELECT signature, 3, CASE event_type WHEN 'click' THEN '!!!not-valid-base64!!!' WHEN 'view' THEN '//////////8='
       ELSE 'AQIDBA==' END
FROM ({ACT}) a WHERE event_type IN ('click', 'view', 'signup')"""


@job("ev_log_filter", _LOG_SQL)
def ev_log_filter(spark, sf):
    """C-3: ``Program data:`` lines of ok transactions, prefix stripped and trimmed."""
    ok = I.ok_transactions(transactions(spark, sf))
    logs = ok.select("signature", F.posexplode("meta.logMessages").alias("pos", "log"))
    logs = logs.where(F.col("log").startswith(EVENT_LOG_PREFIX))
    return logs.select("signature", "pos",
                       F.trim(F.substr(F.col("log"), F.lit(len(EVENT_LOG_PREFIX) + 1))).alias("payload"))


@job("ev_decode", f"SELECT * FROM ({EV}) e")
def ev_decode(spark, sf):
    """D-3 + E-20: every event of every ok transaction, in log order, data as JSON text."""
    return decode_events(spark, sf)


@job("ev_append", f"SELECT * FROM ({EV}) e")
def ev_append(spark, sf):
    """B-2: event append. The sink writes each batch to its own folder with
    overwrite, so replaying a batch (written twice here) leaves one copy."""
    e = decode_events(spark, sf)
    path = scratch_dir(spark, "ev_append")
    S.overwrite_batch(e, path, batch_id=0)
    S.overwrite_batch(e, path, batch_id=0)  # replay of the same batch
    return spark.read.parquet(path).drop("batch_id")


@job("ev_dedup_pg", f"SELECT * FROM ({EV}) e")
def ev_dedup_pg(spark, sf):
    """B-3: Postgres variant -- unique (signature, event_name), first by log order wins.
    Ingesting the events twice still yields one row per key."""
    e = decode_events(spark, sf)
    twice = e.unionByName(e)
    return S.insert_ignore(twice, ["signature", "event_name"], ["slot", "id", "data"]).select(*e.columns)


_SAME_NAMED = f"""
SELECT CAST(2 AS BIGINT) AS id, signature, slot, amount, user_id, k FROM ({ACT}) a WHERE event_type <> 'error'
UNION ALL
SELECT 5, signature, slot, amount + 1, user_id, k FROM ({ACT}) a WHERE event_type <> 'error'"""
_SAME_NAMED_SQL = f"""
SELECT id, signature, slot, '{{"amount":"' || CAST(amount AS VARCHAR) || '","userId":' || CAST(user_id AS VARCHAR)
       || ',"k":' || CAST(k AS VARCHAR) || '}}' AS data FROM ({_SAME_NAMED}) e"""


def _same_named_events(spark, sf):
    """Events of transactions that log ``ValueRecorded`` a second time, with another amount, as their last line."""
    src = D.activity_columns(spark.read.parquet(f"{sf}/events.parquet"))
    again = F.concat(discriminator_hex(DISC_PREFIX_EVENT, F.lit("ValueRecorded")), le_hex(F.col("amount") + 1, 8),
                     le_hex(F.col("user_id"), 4), le_hex(F.col("k"), 2))
    line = F.concat(F.lit(EVENT_LOG_PREFIX), F.base64(F.unhex(again)))
    tx = D.activity_transactions(spark, sf).join(src.select("signature", line.alias("line")), "signature")
    logs = F.concat(F.col("meta.logMessages"), F.array("line"))
    tx = tx.withColumn("meta", F.col("meta").withField("logMessages", logs)).drop("line")
    return I.decode_events(tx, IDL).where("event_name = 'ValueRecorded'")


@job("ev_same_named", _SAME_NAMED_SQL)
def ev_same_named(spark, sf):
    """B-2: two events of one name in a transaction are both appended (no unique key)."""
    return _same_named_events(spark, sf).select("id", "signature", "slot", "data")


@job("ev_same_named_pg", f"SELECT * FROM ({_SAME_NAMED_SQL}) x WHERE id = 2")
def ev_same_named_pg(spark, sf):
    """B-3: under the unique key (signature, event_name) only the first of the two stays."""
    first = S.insert_ignore(_same_named_events(spark, sf), ["signature", "event_name"], ["slot", "id", "data"])
    return first.select("id", "signature", "slot", "data")


_POS_COLS = ["id", "signature", "slot", "arg_quantity", "arg_price", "arg_discount"]


_SECOND_SIBLING = (IX_STL_ALL.replace("4096) * 4096 AS id", "4096) * 4096 + 1 AS id")
                   .replace("CAST(quantity AS VARCHAR) AS arg_quantity", "'0' AS arg_quantity")
                   .replace("CAST(price AS VARCHAR) AS arg_price", "CAST(tax AS VARCHAR) AS arg_price")
                   .replace("CAST(discount AS VARCHAR) AS arg_discount", "'0' AS arg_discount"))


@job("ix_dedup_position", f"""
SELECT {", ".join(_POS_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY signature, id ORDER BY slot, id, block_time NULLS FIRST,
         account_order NULLS FIRST, account_supplier NULLS FIRST, arg_quantity NULLS FIRST, arg_price NULLS FIRST,
         arg_discount NULLS FIRST) AS rn
  FROM ({IX_STL_ALL} UNION ALL {_SECOND_SIBLING}) d
) x WHERE rn = 1""")
def ix_dedup_position(spark, sf):
    """Q-6 / Q-7 option: key (signature, position) keeps every CPI sibling; replays of a
    transaction still collapse to their first copy."""
    d = decoded(spark, sf).where(F.col("ix_name") == "settle")
    order = ["slot", "id"] + [c for c in d.columns if c not in ("ix_name", "signature", "slot", "id")]
    return S.insert_ignore(d, ["ix_name", "signature", "id"], order).select(*_POS_COLS)


@job("ix_typed", f"""
SELECT id, signature, slot, CAST(arg_quantity AS DECIMAL(20,0)) AS arg_quantity,
       CAST(arg_price AS DECIMAL(20,0)) AS arg_price, CAST(arg_discount AS SMALLINT) AS arg_discount
FROM {IX_ALL} x WHERE ix_name = 'settle'""")
def ix_typed(spark, sf):
    """Typed mode: stored text converted to the IDL types (u64 -> decimal(20,0), u8 -> smallint)."""
    t = I.instruction_table(stored(spark, sf, ["settle"]), IDL, "settle", mode="typed")
    return t.select("id", "signature", "slot", "arg_quantity", "arg_price", "arg_discount")


@job("tx_scan_json", f"SELECT * FROM ({TX}) t")
def tx_scan_json(spark, sf):
    """A-1 on the JSON format: transactions written as JSON lines and read back with the
    fixed nested schema (no inference). A gzip file is read by one task, so each holds a bounded number of lines."""
    path = scratch_dir(spark, "tx_json")
    (transactions(spark, sf).write.option("compression", "gzip").option("maxRecordsPerFile", JSON_LINES_PER_FILE)
     .json(path))
    return X.flat(X.read_transactions(spark, path, fmt="json"))


_ARG_COLS = ["ix_name", "signature", "arg_amount", "arg_k", "arg_userid", "arg_quantity", "arg_price", "arg_discount"]


@job("decode_ix_base58", f"SELECT {', '.join(_ARG_COLS)} FROM ({_DECODED_SQL}) d")
def decode_ix_base58(spark, sf):
    """Q-1 option: the same instructions with base58 payload text, decoded with
    ``encoding="base58"`` (Arrow-batched helper; no SQL base58)."""
    from collections import OrderedDict

    from progscan.functions.base58 import base58_encode
    from progscan.functions.codec import lenient_unbase64

    rows = I.program_instructions(transactions(spark, sf), PID)
    rows = rows.withColumn("data", base58_encode(lenient_unbase64(F.col("data"))))
    defs = I.definitions(spark, IDL.instruction_discriminators())
    m = I.match_definitions(rows, F.col("data"), defs, "ix_name", encoding="base58")
    m, _ = I.decode_by_definition(m, "ix_name", OrderedDict((ix.name, list(ix.args)) for ix in IDL.instructions),
                                  "arg_")
    return m.select(*_ARG_COLS)


@job("ix_accounts_instruction", f"""
SELECT ix_name, signature,
       CASE WHEN ix_name = 'settle' THEN account_user ELSE account_authority END AS account_user,
       CASE WHEN ix_name = 'settle' THEN account_authority ELSE account_user END AS account_authority,
       CASE WHEN ix_name = 'settle' THEN account_supplier END AS account_order,
       CASE WHEN ix_name = 'settle' THEN account_order END AS account_supplier
FROM ({_DECODED_SQL}) d""")
def ix_accounts_instruction(spark, sf):
    """Q-2 option: map accounts from the instruction's own list, of top-level and inner instructions alike (both list
    theirs in another order than the transaction's keys)."""
    d = I.decode_instructions(transactions(spark, sf), IDL, PID, accounts="instruction")
    return d.select("ix_name", "signature", "account_user", "account_authority", "account_order", "account_supplier")
