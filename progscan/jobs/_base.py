"""Registry of the jobs exposed to the driver, and shared inputs.

Every job reads the driver's tables (through ``progscan.sources.derived``)
so its work grows with them. Each job has an oracle SQL text for DuckDB
over the same tables when one exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.operators import ingest as I
from progscan.operators import store as S
from progscan.session import split_huge_methods
from progscan.sources import derived as D
from progscan.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def job(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate job {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


IDL = D.ACTIVITY_IDL
PID = D.PROGRAM_ID


def transactions(spark: SparkSession, sf: str, by_slot: int | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """The transaction table (stand-in chain data), derived as it is read: a nested record is some twenty times its
    source row, so a written copy would outweigh all that the jobs do with it."""
    split_huge_methods(spark)
    return D.all_transactions(spark, sf, by_slot, signatures)


def activity_transactions(spark: SparkSession, sf: str) -> DataFrame:
    split_huge_methods(spark)
    return D.activity_transactions(spark, sf)


def raw_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """The account dump as stored: with its 8-byte type prefix as a ``disc`` column,
    so scans by type are pushed Parquet equality filters."""
    from progscan.operators.accounts import with_disc

    return staged(spark, sf, "raw_accounts", lambda: with_disc(D.raw_accounts(spark, sf)), sort_by=["disc", "slot"])


def account_updates(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "account_updates", lambda: D.account_updates(spark, sf), sort_by=["slot"])


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    """All decoded instruction rows (before insert-ignore) -- the ingest decode, computed."""
    return I.decode_instructions(transactions(spark, sf), IDL, PID)


def arrival_order(df: DataFrame) -> list[str]:
    """Arrival order of decoded rows: (slot, id), then the row's own values.

    The test tables repeat some transactions (same signature, other values);
    the trailing columns make "first wins" deterministic for such replays.
    """
    return ["slot", "id"] + [c for c in df.columns if c not in ("ix_name", "signature", "slot", "id")]


def ingest_instructions(spark: SparkSession, sf: str) -> DataFrame:
    """Insert-ignore of the decoded rows: first row per (table, signature)."""
    d = decoded(spark, sf)
    return S.insert_ignore(d, ["ix_name", "signature"], arrival_order(d))


def stored(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    """The stored instruction tables: one folder per table (``ix_name``), sorted by (slot, id).

    With ``names`` only those tables are written. ``ix_name`` is part of the insert-ignore key, so Spark takes the
    filter below that step, down to the discriminators matched: rows of other tables are neither decoded nor shuffled.
    """
    if names is None:
        return staged(spark, sf, "ix_stored", lambda: ingest_instructions(spark, sf),
                      partition_by=["ix_name"], sort_by=["slot", "id"])
    return staged(spark, sf, "ix_stored-" + "-".join(sorted(names)),
                  lambda: ingest_instructions(spark, sf).where(F.col("ix_name").isin(names)),
                  partition_by=["ix_name"], sort_by=["slot", "id"])


def ix_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return I.instruction_table(stored(spark, sf, [name]), IDL, name)


def decode_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event decode from the transaction logs, computed."""
    return I.decode_events(transactions(spark, sf), IDL)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The stored events table, sorted by (slot, id)."""
    return staged(spark, sf, "events", lambda: decode_events(spark, sf), sort_by=["slot", "id"])


# ------------------------------------------------------------- SQL pieces --
# DuckDB twins of the derivations in ``progscan.sources.derived``.

ACT = """
SELECT 'sig' || CAST(event_id AS VARCHAR) AS signature, event_id AS slot, 0 AS tx_index,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS block_time,
       event_type, user_id, CAST(round(value * 100) AS BIGINT) AS amount,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events"""

STL = """
SELECT 'st' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS signature,
       l_orderkey AS slot, l_linenumber AS tx_index, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS block_time,
       l_orderkey, l_suppkey, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS discount,
       CAST(round(l_tax * 100) AS BIGINT) AS tax
FROM lineitem"""

# stored activity instructions (ok transactions only)
IX_ACT = f"""
SELECT event_type AS ix_name, CAST(4096 AS BIGINT) AS id, signature, slot, block_time,
       0 AS cpi_depth, CAST(NULL AS INTEGER) AS parent_ix_index,
       'u' || CAST(user_id AS VARCHAR) AS account_user, 'auth_' || event_type AS account_authority,
       CAST(NULL AS VARCHAR) AS account_order, CAST(NULL AS VARCHAR) AS account_supplier,
       CAST(amount AS VARCHAR) AS arg_amount, CAST(k AS VARCHAR) AS arg_k, CAST(user_id AS VARCHAR) AS arg_userid,
       CAST(NULL AS VARCHAR) AS arg_quantity, CAST(NULL AS VARCHAR) AS arg_price, CAST(NULL AS VARCHAR) AS arg_discount
FROM ({ACT}) a WHERE event_type <> 'error'"""

# decoded settle instructions: the first CPI sibling per transaction
IX_STL_ALL = f"""
SELECT 'settle' AS ix_name, ((CAST(tx_index AS BIGINT) * 2 + 1) * 4096) * 4096 AS id,
       signature || ':cpi:0' AS signature, slot, block_time, 1 AS cpi_depth, 0 AS parent_ix_index,
       CAST(NULL AS VARCHAR) AS account_user, CAST(NULL AS VARCHAR) AS account_authority,
       'o' || CAST(l_orderkey AS VARCHAR) AS account_order, 's' || CAST(l_suppkey AS VARCHAR) AS account_supplier,
       CAST(NULL AS VARCHAR) AS arg_amount, CAST(NULL AS VARCHAR) AS arg_k, CAST(NULL AS VARCHAR) AS arg_userid,
       CAST(quantity AS VARCHAR) AS arg_quantity, CAST(price AS VARCHAR) AS arg_price,
       CAST(discount AS VARCHAR) AS arg_discount
FROM ({STL}) s WHERE l_returnflag <> 'R'"""

# stored settle rows: replayed signatures keep the first by arrival order
IX_STL = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY signature ORDER BY slot, id, block_time NULLS FIRST,
         cpi_depth, parent_ix_index NULLS FIRST, account_order NULLS FIRST, account_supplier NULLS FIRST,
         arg_quantity NULLS FIRST, arg_price NULLS FIRST, arg_discount NULLS FIRST) AS rn
  FROM ({IX_STL_ALL}) d) x WHERE rn = 1"""

IX_ALL = f"({IX_ACT} UNION ALL {IX_STL})"

EV = f"""
SELECT CAST(2 AS BIGINT) AS id, 'ValueRecorded' AS event_name, signature, slot, block_time,
       '{{"amount":"' || CAST(amount AS VARCHAR) || '","userId":' || CAST(user_id AS VARCHAR)
       || ',"k":' || CAST(k AS VARCHAR) || '}}' AS data
FROM ({ACT}) a WHERE event_type <> 'error'
UNION ALL
SELECT CAST(3 AS BIGINT) AS id, 'PurchaseMade' AS event_name, signature, slot, block_time,
       '{{"amount":"' || CAST(amount AS VARCHAR) || '","memo":"order-' || CAST(k AS VARCHAR) || '"}}' AS data
FROM ({ACT}) a WHERE event_type = 'purchase'"""


def ix_where(cond: str) -> str:
    """Oracle rows of the stored instruction tables matching ``cond``."""
    return f"(SELECT * FROM {IX_ALL} x WHERE {cond})"


def ix_sql(name: str) -> str:
    """Oracle rows of one stored instruction table."""
    return ix_where(f"ix_name = '{name}'")


# ---------------------------------------------------- SQL payload builders --

def sql_le_hex(expr: str, n: int) -> str:
    """DuckDB: little-endian hex of an integer in ``n`` bytes (two's complement)."""
    h = f"right(lpad(hex(CAST({expr} AS BIGINT)), 16, '0'), {2 * n})"
    return "(" + " || ".join(f"substr({h}, {2 * i + 1}, 2)" for i in reversed(range(n))) + ")"


def sql_disc(prefix: str, name_expr: str) -> str:
    return f"substr(sha256('{prefix}' || {name_expr}), 1, 16)"


def sql_b64(hex_expr: str) -> str:
    return f"to_base64(unhex({hex_expr}))"


def sql_str_hex(text_expr: str) -> str:
    """DuckDB: Borsh string (u32 LE length + UTF-8 bytes) as hex."""
    return f"({sql_le_hex(f'octet_length(encode({text_expr}))', 4)} || hex(encode({text_expr})))"


# transactions as scanned: one row per derived transaction
TX = f"""
SELECT signature, slot, tx_index, block_time, event_type <> 'error' AS ok FROM ({ACT}) a
UNION ALL
SELECT signature, slot, tx_index, block_time, l_returnflag <> 'R' AS ok FROM ({STL}) s"""

ACT_IX_HEX = (f"({sql_disc('global:', 'event_type')} || {sql_le_hex('amount', 8)} || {sql_le_hex('k', 2)} "
              f"|| {sql_le_hex('user_id', 4)})")
STL_IX_HEX1 = (f"({sql_disc('global:', chr(39) + 'settle' + chr(39))} || {sql_le_hex('quantity', 8)} "
               f"|| {sql_le_hex('price', 8)} || {sql_le_hex('discount', 1)})")
STL_IX_HEX2 = (f"({sql_disc('global:', chr(39) + 'settle' + chr(39))} || {sql_le_hex('0', 8)} "
               f"|| {sql_le_hex('tax', 8)} || {sql_le_hex('0', 1)})")
