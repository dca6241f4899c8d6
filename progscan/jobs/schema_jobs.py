"""Jobs: IDL registry, history, diff, additive schema, catalog, as-of (I-*, H-5, D-7, L-3).

IDL documents are derived from ``part`` (one deployment per part, program =
brand), so their number grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from progscan.functions.binary import le_hex, utf8_len_prefixed_hex
from progscan.functions.codec import DISC_PREFIX_INSTRUCTION, discriminator_hex
from progscan.jobs._base import ACT, job
from progscan.jobs.decode_jobs import idl_docs_sql
from progscan.operators import versions as V
from progscan.plans.idl import Idl
from progscan.sources import derived as D

EXISTING_BEFORE = 1000   # slots below this were registered by an earlier run
AS_OF_BUCKET = 1000      # slot bucket of the as-of range join

_DOCS = idl_docs_sql()
_REG = (f"SELECT program_id, idl_hash, MIN(slot) AS slot FROM "
        f"(SELECT *, substr(sha256(idl_json), 1, 16) AS idl_hash FROM ({_DOCS}) d) h GROUP BY program_id, idl_hash")
# registry rows with the part columns the document was built from
_REG_P = (f"SELECT r.program_id, r.idl_hash, r.slot, lower(p.p_type) AS t, p.p_size AS sz "
          f"FROM ({_REG}) r JOIN part p ON p.p_partkey = r.slot")


def registry(spark, sf):
    return V.register(D.idl_deployments(spark, sf))


@job("idl_register", f"""
WITH h AS (SELECT *, substr(sha256(idl_json), 1, 16) AS idl_hash FROM ({_DOCS}) d),
f AS (SELECT program_id, idl_hash, MIN(slot) AS slot FROM h GROUP BY program_id, idl_hash),
e AS (SELECT DISTINCT program_id, idl_hash FROM h WHERE slot < {EXISTING_BEFORE})
SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.program_id = f.program_id AND e.idl_hash = f.idl_hash)""")
def idl_register(spark, sf):
    """I-3: registering a batch of documents is idempotent on (program, hash)."""
    docs = D.idl_deployments(spark, sf)
    existing = V.register(docs.where(F.col("slot") < EXISTING_BEFORE))
    return V.register(docs, existing).select("program_id", "idl_hash", "slot")


@job("idl_history", f"""
SELECT program_id, idl_hash, slot, row_number() OVER (PARTITION BY program_id ORDER BY slot, idl_hash) AS version_no
FROM ({_REG}) r""")
def idl_history(spark, sf):
    """I-6: versions per program in registration order."""
    return V.history(registry(spark, sf)).select("program_id", "idl_hash", "slot", "version_no")


@job("idl_diff", f"""
WITH v AS (SELECT *, lag(slot) OVER w AS prev_slot, lag(t) OVER w AS prev_t, lag(sz) OVER w AS prev_sz
           FROM ({_REG_P}) r WINDOW w AS (PARTITION BY program_id ORDER BY slot, idl_hash))
SELECT program_id, slot, 'instruction' AS change, t AS ix_name, CAST(NULL AS VARCHAR) AS arg_name
FROM v WHERE prev_slot IS NOT NULL AND t <> prev_t
UNION ALL
SELECT program_id, slot, 'arg', t, 'label' FROM v
WHERE prev_slot IS NOT NULL AND t = prev_t AND sz > 25 AND prev_sz <= 25
UNION ALL
SELECT program_id, slot, 'arg', t, 'tags' FROM v
WHERE prev_slot IS NOT NULL AND t = prev_t AND sz > 40 AND prev_sz <= 40""")
def idl_diff(spark, sf):
    """H-5: new instructions, and new args of shared instructions, between consecutive versions."""
    return V.diff(registry(spark, sf))


_HEAD = "(0, 'id', 'INTEGER'), (1, 'signature', 'TEXT'), (2, 'slot', 'INTEGER'), (3, 'block_time', 'INTEGER'), " \
        "(4, 'cpi_depth', 'INTEGER'), (5, 'parent_ix_index', 'INTEGER')"


def _tables_sql(src: str) -> str:
    """Columns of the two instruction tables of each document row in ``src``."""
    return f"""
SELECT l.program_id, l.slot, 'ix_' || l.program_id || '_initialize' AS table_name, c.ordinal, c.column_name,
       c.storage_type
FROM ({src}) l, (VALUES {_HEAD}, (6, 'account_authority', 'TEXT'), (7, 'arg_bump', 'INTEGER'),
                 (8, 'indexed_at', 'INTEGER')) c(ordinal, column_name, storage_type)
UNION ALL
SELECT l.program_id, l.slot, 'ix_' || l.program_id || '_' || l.t, c.ordinal, c.column_name, c.storage_type
FROM ({src}) l, (VALUES {_HEAD}, (6, 'account_owner', 'TEXT'), (7, 'arg_size', 'INTEGER'),
                 (8, 'arg_price', 'TEXT')) c(ordinal, column_name, storage_type)
UNION ALL
SELECT l.program_id, l.slot, 'ix_' || l.program_id || '_' || l.t, 9, 'arg_label', 'TEXT' FROM ({src}) l
WHERE sz > 25
UNION ALL
SELECT l.program_id, l.slot, 'ix_' || l.program_id || '_' || l.t, 10, 'arg_tags', 'TEXT' FROM ({src}) l
WHERE sz > 40
UNION ALL
SELECT l.program_id, l.slot, 'ix_' || l.program_id || '_' || l.t,
       9 + CAST(sz > 25 AS INTEGER) + CAST(sz > 40 AS INTEGER), 'indexed_at', 'INTEGER' FROM ({src}) l"""


_LATEST = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY slot DESC) AS rn "
           f"FROM ({_REG_P}) r) x WHERE rn = 1")


@job("schema_tables", f"SELECT program_id, table_name, ordinal, column_name, storage_type "
                      f"FROM ({_tables_sql(_LATEST)}) t")
def schema_tables(spark, sf):
    """I-1: table / ordinal / column / storage type of every program's current IDL."""
    t = V.schema_tables(V.latest(registry(spark, sf)))
    return t.select("program_id", "table_name", "ordinal", "column_name", "storage_type")


def _account_tables_sql(src: str) -> str:
    return f"""
SELECT l.program_id, l.slot, 'acc_' || l.program_id || '_state' AS table_name, c.ordinal, c.column_name, c.storage_type
FROM ({src}) l, (VALUES (0, 'id', 'INTEGER'), (1, 'pubkey', 'TEXT'), (2, 'slot', 'INTEGER'), (3, 'total', 'TEXT'),
                 (4, 'maxsize', 'INTEGER'), (5, 'updated_at', 'INTEGER')) c(ordinal, column_name, storage_type)"""


@job("schema_account_tables", f"SELECT program_id, table_name, ordinal, column_name, storage_type "
                              f"FROM ({_account_tables_sql(_LATEST)}) t")
def schema_account_tables(spark, sf):
    """I-1 for the account types of every program's current IDL (nested options count as what they hold)."""
    t = V.account_schema_tables(V.latest(registry(spark, sf)))
    return t.select("program_id", "table_name", "ordinal", "column_name", "storage_type")


@job("schema_evolve", f"""
SELECT program_id, table_name, column_name, MIN(slot) AS first_slot, MIN(storage_type) AS storage_type
FROM ({_tables_sql(_REG_P)} UNION ALL {_account_tables_sql(_REG_P)}) t GROUP BY program_id, table_name, column_name""")
def schema_evolve(spark, sf):
    """I-5: additive migration -- each column ever declared and the version that added it."""
    e = V.evolve(registry(spark, sf))
    return e.select("program_id", "table_name", "column_name", "first_slot", "storage_type")


@job("schema_catalog", f"""
SELECT program_id, slot, '0.' || CAST(sz AS VARCHAR) || '.0' AS version, 'initialize' AS ix_name,
       1 AS n_accounts, 1 AS n_args FROM ({_REG_P}) r
UNION ALL
SELECT program_id, slot, '0.' || CAST(sz AS VARCHAR) || '.0', t, 1,
       2 + CAST(sz > 25 AS INTEGER) + CAST(sz > 40 AS INTEGER) FROM ({_REG_P}) r""")
def schema_catalog(spark, sf):
    """D-7: per registered version: its instructions with account and arg counts."""
    return V.catalog(registry(spark, sf))


_VERSION = "'0.' || CAST(sz AS VARCHAR) || '.0'"


@job("schema_listing", f"""
SELECT program_id, slot, {_VERSION} AS version, 'instruction' AS kind, 'initialize' AS name, 'authority mut signer' AS accounts,
       'bump: u8' AS fields FROM ({_REG_P}) r
UNION ALL
SELECT program_id, slot, {_VERSION}, 'instruction', t, 'owner mut signer',
       'size: u32; price: u64' || CASE WHEN sz > 25 THEN '; label: string' ELSE '' END
       || CASE WHEN sz > 40 THEN '; tags: {{"vec":"u8"}}' ELSE '' END FROM ({_REG_P}) r
UNION ALL
SELECT program_id, slot, {_VERSION}, 'account', 'State', '', 'total: u64; maxSize: {{"option":{{"option":"u16"}}}}' FROM ({_REG_P}) r
UNION ALL
SELECT program_id, slot, {_VERSION}, 'event', 'Resized', '', 'size: u32' FROM ({_REG_P}) r""")
def schema_listing(spark, sf):
    """D-7: the full listing: instructions with their accounts and arguments, account types, events."""
    rows = V.listing(registry(spark, sf))
    return rows.select("program_id", "slot", "version", "kind", "name", F.array_join("accounts", "; ").alias("accounts"),
                       F.array_join("fields", "; ").alias("fields"))


@job("idl_as_of", f"""
WITH l AS (SELECT 'st' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS signature,
                  l_orderkey AS slot, regexp_replace(lower(p_brand), '[^a-z0-9]', '_', 'g') AS program_id
           FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS ({_REG})
SELECT l.signature, l.slot, l.program_id, r.slot AS version_slot, r.idl_hash
FROM l ASOF LEFT JOIN r ON l.program_id = r.program_id AND l.slot >= r.slot""")
def idl_as_of(spark, sf):
    """L-3: the IDL version valid at each transaction's slot (range join, no broadcast)."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet").select(
        "p_partkey", F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "_").alias("program_id"))
    rows = li.join(part, li["l_partkey"] == part["p_partkey"], "inner").select(
        F.concat(F.lit("st"), F.col("l_orderkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string")).alias("signature"),
        F.col("l_orderkey").alias("slot"), "program_id")
    reg = registry(spark, sf).select("program_id", "slot", "idl_hash")
    return V.as_of(rows, reg, AS_OF_BUCKET).select("signature", "slot", "program_id", "version_slot", "idl_hash")


@job("idl_extract", f"SELECT program_id, slot, substr(sha256(idl_json), 1, 16) AS idl_hash FROM ({_DOCS}) d")
def idl_extract(spark, sf):
    """A-12: documents read back from program-account bytes (8 + 32 header, u32 length,
    body); short or unreadable accounts are skipped."""
    from progscan.functions.binary import le_hex
    from progscan.functions.codec import DISC_PREFIX_ACCOUNT, discriminator_hex, idl_hash_hex
    from progscan.sources.idl_accounts import extract_idl

    docs = D.idl_deployments(spark, sf)
    body = F.encode(F.col("idl_json"), "UTF-8")
    data = F.unhex(F.concat(discriminator_hex(DISC_PREFIX_ACCOUNT, F.lit("IdlAccount")), F.lit("00" * 32),
                            le_hex(F.length(body), 4), F.hex(body)))
    acc = docs.select("program_id", "slot", data.alias("data"))
    out = extract_idl(acc, ["program_id", "slot"])
    return out.select("program_id", "slot", idl_hash_hex(F.col("idl_json")).alias("idl_hash"))


@job("idl_upgrades", f"""
SELECT program_id, slot, idl_hash, prev_hash FROM (
  SELECT program_id, slot, idl_hash, lag(idl_hash) OVER (PARTITION BY program_id ORDER BY slot) AS prev_hash
  FROM (SELECT program_id, slot, substr(sha256(idl_json), 1, 16) AS idl_hash FROM ({_DOCS}) d) h
) x WHERE prev_hash IS NULL OR prev_hash <> idl_hash""")
def idl_upgrades(spark, sf):
    """I-4: upgrade detection -- a deployment whose hash differs from the current one."""
    return V.upgrades(D.idl_deployments(spark, sf)).select("program_id", "slot", "idl_hash", "prev_hash")


UPGRADE_SLOT = 6000
_ARGS_BEFORE = [{"name": "amount", "type": "u64"}, {"name": "k", "type": "u16"}]
_ARGS_AFTER = [{"name": "userId", "type": "u32"}, {"name": "label", "type": "string"}, {"name": "amount", "type": "u64"}]


def _version(args: list) -> Idl:
    return Idl.from_dict({"name": "activity", "instructions": [
        {"name": t, "accounts": [{"name": "user"}], "args": args} for t in D.EVENT_TYPES]})


@job("decode_as_of", f"""
SELECT event_type AS ix_name, signature, slot, 'u' || CAST(user_id AS VARCHAR) AS account_user,
       CAST(amount AS VARCHAR) AS arg_amount, CASE WHEN slot < {UPGRADE_SLOT} THEN CAST(k AS VARCHAR) END AS arg_k,
       CASE WHEN slot >= {UPGRADE_SLOT} THEN CAST(user_id AS VARCHAR) END AS arg_userid,
       CASE WHEN slot >= {UPGRADE_SLOT} THEN 'l' || CAST(k AS VARCHAR) END AS arg_label,
       CAST(CASE WHEN slot < {UPGRADE_SLOT} THEN 0 ELSE {UPGRADE_SLOT} END AS BIGINT) AS version_slot
FROM ({ACT}) a WHERE event_type <> 'error'""")
def decode_as_of(spark, sf):
    """L-3: a program upgraded at a slot to other arguments; each instruction is decoded with the version valid at
    its slot, in one scan."""
    src = D.activity_columns(spark.read.parquet(f"{sf}/events.parquet"))
    disc = discriminator_hex(DISC_PREFIX_INSTRUCTION, F.col("event_type"))
    before = F.concat(disc, le_hex(F.col("amount"), 8), le_hex(F.col("k"), 2))
    after = F.concat(disc, le_hex(F.col("user_id"), 4), utf8_len_prefixed_hex(F.concat(F.lit("l"), F.col("k").cast("string"))),
                     le_hex(F.col("amount"), 8))
    data = F.base64(F.unhex(F.when(F.col("slot") < UPGRADE_SLOT, before).otherwise(after)))
    tx = D.activity_transactions(spark, sf).join(src.select("signature", data.alias("data")), "signature")
    ix = F.transform("transaction.message.instructions", lambda x: F.when(
        x["programId"] == D.PROGRAM_ID, x.withField("data", F.col("data"))).otherwise(x))
    tx = tx.withColumn("transaction", F.col("transaction").withField("message.instructions", ix)).drop("data")
    versions = [(0, _version(_ARGS_BEFORE)), (UPGRADE_SLOT, _version(_ARGS_AFTER))]
    out = V.decode_as_of(tx, versions, D.PROGRAM_ID)
    return out.select("ix_name", "signature", "slot", "account_user", "arg_amount", "arg_k", "arg_userid", "arg_label",
                      "version_slot")
