"""Jobs: payload decode round trips (E-6..E-18), discriminators, hashes, names.

Each job encodes values taken from ``events`` into Borsh bytes with Spark
expressions, decodes them with the compiled field list, and returns the
decoded stored texts. The oracle is the un-encoded source values.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from progscan.functions.binary import le_hex, utf8_len_prefixed_hex
from progscan.functions.codec import (
    DISC_PREFIX_ACCOUNT, DISC_PREFIX_EVENT, DISC_PREFIX_INSTRUCTION, discriminator_hex, idl_hash_hex, table_name,
)
from progscan.jobs._base import ACT, job
from progscan.plans.decode import decode_fields
from progscan.plans.idl import Field, Idl
from progscan.sources import derived as D

_DISC = "0000000000000000"  # 8 leading bytes the decoders skip


def _decode(spark, sf, parts: list[Column], fields: list[tuple[str, object]], registry=None):
    src = D.activity_columns(spark.read.parquet(f"{sf}/events.parquet"))
    src = src.withColumn("raw", F.unhex(F.concat(F.lit(_DISC), *parts)))
    names = [n for n, _ in fields]
    out = decode_fields(src, "raw", [Field(n, t) for n, t in fields], names, registry=registry)
    return out.select("signature", *names)


def _c(name):
    return F.col(name)


# ---------------------------------------------------------------- u64 -----

@job("decode_u64", f"""
SELECT signature,
       CAST(CAST(4294967295 - user_id AS HUGEINT) * 4294967296 + amount AS VARCHAR) AS big,
       CAST(amount AS VARCHAR) AS small
FROM ({ACT}) a""")
def decode_u64(spark, sf):
    """E-9: full unsigned 64-bit range as decimal text (values above 2^63)."""
    parts = [le_hex(_c("amount"), 4), le_hex(F.lit(4294967295) - _c("user_id"), 4), le_hex(_c("amount"), 8)]
    return _decode(spark, sf, parts, [("big", "u64"), ("small", "u64")])


# ------------------------------------------------------------- scalars -----

_SCALARS = [("flag", "bool"), ("small", "u8"), ("delta", "i8"), ("mid", "i16"), ("wide", "u32"),
            ("neg", "i32"), ("big", "i64"), ("id", "u128"), ("key", "publicKey"), ("tail", "u64"),
            ("tail16", "u16")]


@job("decode_scalars", f"""
SELECT signature,
       CASE WHEN amount % 2 = 1 THEN 'true' ELSE 'false' END AS flag,
       CAST(k AS VARCHAR) AS small, CAST(k - 50 AS VARCHAR) AS delta, CAST(k * 300 - 15000 AS VARCHAR) AS mid,
       CAST(4294967295 - user_id AS VARCHAR) AS wide, CAST(-amount AS VARCHAR) AS neg,
       CAST(-(amount * 1000000007) AS VARCHAR) AS big,
       '0x' || lower(lpad(hex(user_id), 16, '0') || lpad(hex(amount), 16, '0')) AS id,
       to_base64(unhex(sha256(signature))) AS key,
       CAST(NULL AS VARCHAR) AS tail, CAST(k AS VARCHAR) AS tail16
FROM ({ACT}) a""")
def decode_scalars(spark, sf):
    """E-6..E-8, E-10, E-11, E-13, Q-5: every fixed-width scalar; a u64 that runs past the
    end is NULL and the following u16 is read at the same offset."""
    parts = [
        F.when(_c("amount") % 2 == 1, F.lit("01")).otherwise(F.lit("00")),
        le_hex(_c("k"), 1), le_hex(_c("k") - 50, 1), le_hex(_c("k") * 300 - 15000, 2),
        le_hex(F.lit(4294967295) - _c("user_id"), 4), le_hex(-_c("amount"), 4),
        le_hex(-(_c("amount") * 1000000007), 8),
        le_hex(_c("amount"), 8), le_hex(_c("user_id"), 8),
        F.sha2(_c("signature"), 256),
        le_hex(_c("k"), 4),
    ]
    return _decode(spark, sf, parts, _SCALARS)


# -------------------------------------------------------------- string -----

_MEMO_SQL = "event_type || '-' || CAST(user_id AS VARCHAR) || ' ünï \"q\"'"


@job("decode_string", f"""
SELECT signature,
       CASE WHEN event_type = 'error' THEN NULL ELSE {_MEMO_SQL} END AS memo,
       CASE WHEN event_type = 'error' THEN '1000' ELSE CAST(user_id AS VARCHAR) END AS after
FROM ({ACT}) a""")
def decode_string(spark, sf):
    """E-14: u32-prefixed UTF-8; an overrunning length gives NULL and keeps the offset,
    so the next u32 reads the length prefix itself."""
    memo = F.concat(_c("event_type"), F.lit("-"), _c("user_id").cast("string"), F.lit(' ünï "q"'))
    s = F.when(_c("event_type") == "error", F.concat(le_hex(F.lit(1000), 4), F.hex(F.encode(memo, "UTF-8")))) \
        .otherwise(utf8_len_prefixed_hex(memo))
    return _decode(spark, sf, [s, le_hex(_c("user_id"), 4)], [("memo", "string"), ("after", "u32")])


# -------------------------------------------------------------- option -----

@job("decode_option", f"""
SELECT signature, CASE WHEN amount % 2 = 0 THEN CAST(amount AS VARCHAR) ELSE NULL END AS maybe,
       CAST(k AS VARCHAR) AS k
FROM ({ACT}) a""")
def decode_option(spark, sf):
    """E-15: tag 0 -> NULL (one byte); any other tag (1, or 2 for views) -> the value."""
    tag = F.when(_c("event_type") == "view", F.lit("02")).otherwise(F.lit("01"))
    opt = F.when(_c("amount") % 2 == 0, F.concat(tag, le_hex(_c("amount"), 8))).otherwise(F.lit("00"))
    return _decode(spark, sf, [opt, le_hex(_c("k"), 2)], [("maybe", {"option": "u64"}), ("k", "u16")])


# ----------------------------------------------------------------- vec -----

@job("decode_vec", f"""
SELECT signature,
       CASE WHEN event_type = 'error'
            THEN '[' || array_to_string(list_concat(list_transform(range(0, k % 4), lambda i: k + i),
                                                     [user_id % 65536, user_id // 65536]), ',') || ']'
            ELSE '[' || array_to_string(list_transform(range(0, k % 4), lambda i: k + i), ',') || ']' END AS items,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS tail
FROM ({ACT}) a""")
def decode_vec(spark, sf):
    """E-16: u32 count + elements; a count larger than the data stops when bytes run out
    (error rows claim 1000 items: the trailing u32 is read as two more u16)."""
    n = _c("k") % 4
    elems = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)) - 1),
                                                   lambda i: le_hex(_c("k") + i, 2)), "")).otherwise(F.lit(""))
    elems = F.when(n > 0, elems).otherwise(F.lit(""))
    count = F.when(_c("event_type") == "error", le_hex(F.lit(1000), 4)).otherwise(le_hex(n, 4))
    return _decode(spark, sf, [count, elems, le_hex(_c("user_id"), 4)], [("items", {"vec": "u16"}), ("tail", "u32")])


# --------------------------------------------------------------- array -----

@job("decode_array", f"""
SELECT signature,
       '[' || CAST(user_id % 256 AS VARCHAR) || ',' || CAST((user_id // 256) % 256 AS VARCHAR) || ','
           || CAST((user_id // 65536) % 256 AS VARCHAR) || ',' || CAST(user_id // 16777216 AS VARCHAR) || ']' AS bytes,
       '[' || CAST(k AS VARCHAR) || ',' || CAST(amount % 65536 AS VARCHAR) || ']' AS pair
FROM ({ACT}) a""")
def decode_array(spark, sf):
    """E-17: fixed-length arrays as JSON text."""
    parts = [le_hex(_c("user_id"), 4), le_hex(_c("k"), 2), le_hex(_c("amount") % 65536, 2)]
    return _decode(spark, sf, parts, [("bytes", {"array": ["u8", 4]}), ("pair", {"array": ["u16", 2]})])


# ------------------------------------------------------------- defined -----

@job("decode_defined", f"""
SELECT signature,
       CASE k % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[null]' ELSE '[null,null]' END AS steps,
       CAST(CAST(amount AS HUGEINT) * CAST(power(65536, k % 3) AS HUGEINT) AS VARCHAR) AS amount
FROM ({ACT}) a""")
def decode_defined(spark, sf):
    """E-18 + Q-4: ``vec<defined>`` yields NULL items that consume no bytes, so the next
    field is read from inside the items (the reference's behaviour, kept in stored mode)."""
    c = _c("k") % 3
    items = F.repeat(F.lit("0000"), c.cast("int"))
    parts = [le_hex(c, 4), items, le_hex(_c("amount"), 8)]
    return _decode(spark, sf, parts, [("steps", {"vec": {"defined": "Hop"}}), ("amount", "u64")])


_TYPES = Idl.from_dict({"name": "desk", "instructions": [], "types": [
    {"name": "Hop", "type": {"kind": "struct", "fields": [
        {"name": "shard", "type": "u16"}, {"name": "weight", "type": "u32"}, {"name": "pool", "type": "publicKey"},
        {"name": "pair", "type": {"array": ["u8", 2]}}]}},
    {"name": "Side", "type": {"kind": "enum", "variants": [{"name": "Bid"}, {"name": "Ask"}, {"name": "Cross"}]}},
    {"name": "Ticket", "type": {"kind": "struct", "fields": [
        {"name": "note", "type": "string"}, {"name": "side", "type": {"defined": "Side"}},
        {"name": "size", "type": {"option": "u64"}}]}},
    {"name": "Action", "type": {"kind": "enum", "variants": [
        {"name": "Hold"}, {"name": "Move", "fields": [{"name": "to", "type": "u32"},
                                                      {"name": "tags", "type": {"vec": "string"}}]},
        {"name": "Tick", "fields": ["u16"]}]}}]}).type_def


def _repeated(n: Column, item) -> Column:
    """Hex of ``item(0), item(1), ...``, ``n`` of them."""
    items = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)) - 1), item)
    return F.when(n > 0, F.array_join(items, "")).otherwise(F.lit(""))


@job("decode_defined_typed", f"""
SELECT signature,
       '[' || array_to_string(list_transform(range(0, k % 3), lambda i:
              '{{"shard":' || CAST(k + i AS VARCHAR) || ',"weight":' || CAST(user_id AS VARCHAR)
              || ',"pool":"' || to_base64(unhex(sha256(signature))) || '","pair":[' || CAST(i AS VARCHAR) || ','
              || CAST(100 - i AS VARCHAR) || ']}}'), ',') || ']' AS steps,
       CAST(amount AS VARCHAR) AS amount
FROM ({ACT}) a""")
def decode_defined_typed(spark, sf):
    """E-18 typed mode: ``vec<defined>`` decoded as structs from the IDL's type registry,
    so the following field is read at the right offset (Q-4 corrected)."""
    c = _c("k") % 3
    items = _repeated(c, lambda i: F.concat(le_hex(_c("k") + i, 2), le_hex(_c("user_id"), 4),
                                            F.sha2(_c("signature"), 256), le_hex(i, 1), le_hex(F.lit(100) - i, 1)))
    parts = [le_hex(c, 4), items, le_hex(_c("amount"), 8)]
    return _decode(spark, sf, parts, [("steps", {"vec": {"defined": "Hop"}}), ("amount", "u64")], registry=_TYPES)


@job("decode_typed_enum", f"""
SELECT signature, CASE WHEN event_type <> 'error' THEN (['Bid', 'Ask', 'Cross'])[k % 3 + 1] END AS side,
       CASE WHEN event_type <> 'error' AND k % 2 = 1 THEN (['Bid', 'Ask', 'Cross'])[user_id % 3 + 1] END AS other,
       CASE WHEN event_type <> 'error' THEN CAST(amount AS VARCHAR) END AS amount
FROM ({ACT}) a""")
def decode_typed_enum(spark, sf):
    """E-18 typed mode: an enum without fields is its variant's name, alone or in an option. Error rows hold an
    unknown variant: the field is NULL and nothing after it is read (Q-5)."""
    side = F.when(_c("event_type") == "error", F.lit("09")).otherwise(le_hex(_c("k") % 3, 1))
    other = F.when(_c("k") % 2 == 1, F.concat(F.lit("01"), le_hex(_c("user_id") % 3, 1))).otherwise(F.lit("00"))
    return _decode(spark, sf, [side, other, le_hex(_c("amount"), 8)],
                   [("side", {"defined": "Side"}), ("other", {"option": {"defined": "Side"}}), ("amount", "u64")],
                   registry=_TYPES)


@job("decode_typed_mixed", f"""
SELECT signature,
       CASE WHEN event_type <> 'error' THEN '[' || array_to_string(list_transform(range(0, k % 3), lambda i:
         '{{"note":"n' || CAST(k AS VARCHAR) || '","side":"' || (['Bid', 'Ask', 'Cross'])[i + 1] || '","size":'
         || CASE WHEN i % 2 = 1 THEN 'null' ELSE '"' || CAST(amount AS VARCHAR) || '"' END || '}}'), ',') || ']' END AS tickets,
       CASE WHEN event_type = 'error' THEN NULL WHEN k % 3 = 0 THEN '{{"Hold":{{}}}}'
            WHEN k % 3 = 1 THEN '{{"Move":{{"to":' || CAST(user_id AS VARCHAR) || ',"tags":["t' || CAST(k AS VARCHAR) || '",""]}}}}'
            ELSE '{{"Tick":{{"0":' || CAST(k AS VARCHAR) || '}}}}' END AS action,
       CASE WHEN event_type <> 'error' THEN CAST(amount AS VARCHAR) END AS amount
FROM ({ACT}) a""")
def decode_typed_mixed(spark, sf):
    """E-16 + E-18 typed mode: vectors of structs with strings and options, and an enum with fields. Error rows claim
    one ticket more than they hold: the field is NULL and nothing after it is read."""
    c = _c("k") % 3
    note = utf8_len_prefixed_hex(F.concat(F.lit("n"), _c("k").cast("string")))
    ticket = lambda i: F.concat(note, le_hex(i, 1), F.when(i % 2 == 1, F.lit("00")).otherwise(
        F.concat(F.lit("01"), le_hex(_c("amount"), 8))))
    tags = F.concat(le_hex(F.lit(2), 4), utf8_len_prefixed_hex(F.concat(F.lit("t"), _c("k").cast("string"))),
                    utf8_len_prefixed_hex(F.lit("")))
    action = F.when(c == 0, F.lit("00")).when(c == 1, F.concat(F.lit("01"), le_hex(_c("user_id"), 4), tags)).otherwise(
        F.concat(F.lit("02"), le_hex(_c("k"), 2)))
    good = F.concat(le_hex(c, 4), _repeated(c, ticket), action, le_hex(_c("amount"), 8))
    parts = [F.when(_c("event_type") == "error", F.concat(le_hex(c + 1, 4), _repeated(c, ticket))).otherwise(good)]
    return _decode(spark, sf, parts, [("tickets", {"vec": {"defined": "Ticket"}}), ("action", {"defined": "Action"}),
                                      ("amount", "u64")], registry=_TYPES)


@job("decode_vec_nested", f"""
SELECT signature,
       '[' || array_to_string(list_transform(range(0, k % 3), lambda i: '"[' || CAST(k + i AS VARCHAR) || ',' || CAST(i AS VARCHAR)
              || ']"'), ',') || ']' AS pairs,
       '["a' || CAST(k AS VARCHAR) || '",""]' AS labels,
       '[null,' || CAST(user_id AS VARCHAR) || ']' AS maybe,
       CAST(user_id AS VARCHAR) AS tail
FROM ({ACT}) a""")
def decode_vec_nested(spark, sf):
    """E-16: vectors of vectors (JSON strings inside the list, as stored), of strings and of options."""
    c = _c("k") % 3
    pairs = F.concat(le_hex(c, 4), _repeated(c, lambda i: F.concat(le_hex(F.lit(2), 4), le_hex(_c("k") + i, 2), le_hex(i, 2))))
    labels = F.concat(le_hex(F.lit(2), 4), utf8_len_prefixed_hex(F.concat(F.lit("a"), _c("k").cast("string"))),
                      utf8_len_prefixed_hex(F.lit("")))
    maybe = F.concat(le_hex(F.lit(2), 4), F.lit("0001"), le_hex(_c("user_id"), 4))
    return _decode(spark, sf, [pairs, labels, maybe, le_hex(_c("user_id"), 4)],
                   [("pairs", {"vec": {"vec": "u16"}}), ("labels", {"vec": "string"}),
                    ("maybe", {"vec": {"option": "u32"}}), ("tail", "u32")])


@job("decode_vec_overrun", f"""
SELECT signature,
       '{{"items":["s' || CAST(k AS VARCHAR) || '"],"item":null,"count":' || CAST(3000000000 + k AS VARCHAR) || '}}' AS items,
       CAST(1000 + k AS VARCHAR) AS tail
FROM ({ACT}) a""")
def decode_vec_overrun(spark, sf):
    """E-16 + Q-4: a count far beyond the data. A string that overruns reads as NULL and moves nothing, so all further
    items read the same: they are stored as the item and its exact count. The next field starts at that string."""
    parts = [le_hex(F.lit(3000000001) + _c("k"), 4), utf8_len_prefixed_hex(F.concat(F.lit("s"), _c("k").cast("string"))),
             le_hex(F.lit(1000) + _c("k"), 4)]
    return _decode(spark, sf, parts, [("items", {"vec": "string"}), ("tail", "u32")])


@job("decode_zero_width", f"""
SELECT signature, '{{"item":null,"count":' || CAST(3000000000 + k AS VARCHAR) || '}}' AS steps, CAST(k AS VARCHAR) AS tail
FROM ({ACT}) a""")
def decode_zero_width(spark, sf):
    """Q-4: items of a defined type take no bytes in stored mode, so their count has no bound; it is kept exactly."""
    parts = [le_hex(F.lit(3000000000) + _c("k"), 4), le_hex(_c("k"), 2)]
    return _decode(spark, sf, parts, [("steps", {"vec": {"defined": "Hop"}}), ("tail", "u16")])


# -------------------------------------------------------------- floats -----

# doubles and their ECMAScript texts
_DOUBLES = [(0.0, "0"), (-0.0, "0"), (1.5, "1.5"), (-2.25, "-2.25"), (12345678.5, "12345678.5"), (0.0005, "0.0005"),
            (1e21, "1e+21"), (-1e20, "-100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (-1.25e-9, "-1.25e-9"),
            (123456789012345680.0, "123456789012345680"), (1.7976931348623157e308, "1.7976931348623157e+308"),
            (float("inf"), "Infinity"), (float("-inf"), "-Infinity"), (float("nan"), "NaN"), (0.1, "0.1"), (-7.0, "-7")]
_FLOATS = [(0.5, "0.5"), (0.1, "0.10000000149011612"), (-3e10, "-30000001024"), (1e-10, "1.000000013351432e-10"), (100.0, "100")]


def _by_k(choices: list, of) -> Column:
    at = (_c("k") % len(choices) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(of(c)) for c in choices]), at)


def _sql_by_k(texts: list[str]) -> str:
    return "([" + ", ".join(f"'{t}'" for t in texts) + f"])[k % {len(texts)} + 1]"


@job("decode_floats", f"""
SELECT signature, {_sql_by_k([t for _, t in _DOUBLES])} AS d, {_sql_by_k([t for _, t in _FLOATS])} AS f,
       '[' || {_sql_by_k([t if t[-1].isdigit() else 'null' for _, t in _DOUBLES])} || ',' || CAST(k AS VARCHAR) || ']' AS list
FROM ({ACT}) a""")
def decode_floats(spark, sf):
    """E-12 + E-21: f32 and f64 as ECMAScript prints them; in JSON what is no number is null."""
    d = _by_k(_DOUBLES, lambda c: struct.pack("<d", c[0]).hex())
    f = _by_k(_FLOATS, lambda c: struct.pack("<f", c[0]).hex())
    whole = F.element_at(F.array(*[F.lit(struct.pack("<d", float(i)).hex()) for i in range(100)]), (_c("k") + 1).cast("int"))
    return _decode(spark, sf, [d, f, le_hex(F.lit(2), 4), d, whole], [("d", "f64"), ("f", "f32"), ("list", {"vec": "f64"})])


# ------------------------------------------------- discriminators, names ---

@job("disc_ix", "SELECT DISTINCT event_type AS name, substr(sha256('global:' || event_type), 1, 16) AS disc "
                "FROM events")
def disc_ix(spark, sf):
    """E-1: sha256("global:" + name)[0:8] for every instruction name in the data."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("name")).distinct()
    return e.select("name", discriminator_hex(DISC_PREFIX_INSTRUCTION, F.col("name")).alias("disc"))


@job("disc_event", "SELECT DISTINCT event_type AS name, substr(sha256('event:' || event_type), 1, 16) AS disc "
                   "FROM events")
def disc_event(spark, sf):
    """E-2: sha256("event:" + name)[0:8]."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("name")).distinct()
    return e.select("name", discriminator_hex(DISC_PREFIX_EVENT, F.col("name")).alias("disc"))


@job("disc_account", "SELECT DISTINCT c_mktsegment AS name, substr(sha256('account:' || c_mktsegment), 1, 16) "
                     "AS disc FROM customer")
def disc_account(spark, sf):
    """E-3: sha256("account:" + name)[0:8]."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_mktsegment").alias("name")).distinct()
    return c.select("name", discriminator_hex(DISC_PREFIX_ACCOUNT, F.col("name")).alias("disc"))


@job("name_norm", "SELECT p_partkey, regexp_replace(lower('ix_' || p_brand || '_' || p_type), '[^a-z0-9_]', '_', 'g') "
                  "AS table_name FROM part")
def name_norm(spark, sf):
    """E-26: table names, lower-cased, every character outside [a-z0-9_] -> '_'."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", table_name("ix", F.col("p_brand"), F.col("p_type")).alias("table_name"))


def idl_docs_sql() -> str:
    """DuckDB twin of ``derived.idl_deployments``."""
    prog = "regexp_replace(lower(p_brand), '[^a-z0-9]', '_', 'g')"
    args = ("""'[{"name":"size","type":"u32"},{"name":"price","type":"u64"}' || """
            """CASE WHEN p_size > 25 THEN ',{"name":"label","type":"string"}' ELSE '' END || """
            """CASE WHEN p_size > 40 THEN ',{"name":"tags","type":{"vec":"u8"}}' ELSE '' END || ']'""")
    doc = (f"""'{{"version":"0.' || CAST(p_size AS VARCHAR) || '.0","name":"' || {prog} || """
           """'","instructions":[{"name":"initialize","accounts":[{"name":"authority","isMut":true,"""
           """"isSigner":true}],"args":[{"name":"bump","type":"u8"}]},{"name":"' || lower(p_type) || """
           f"""'","accounts":[{{"name":"owner","isMut":true,"isSigner":true}}],"args":' || {args} || """
           """'}],"accounts":[{"name":"State","type":{"kind":"struct","fields":[{"name":"total","type":"u64"},{"name":"maxSize","type":{"option":{"option":"u16"}}}]}}],"events":[{"name":"Resized","fields":[{"name":"size","type":"u32"}]}]}'""")
    return f"SELECT {prog} AS program_id, p_partkey AS slot, {doc} AS idl_json FROM part"


@job("idl_hash", f"SELECT program_id, slot, substr(sha256(idl_json), 1, 16) AS idl_hash FROM ({idl_docs_sql()}) d")
def idl_hash(spark, sf):
    """E-25 / I-4: document hash = sha256(JSON text)[0:16 hex] per deployed IDL."""
    d = D.idl_deployments(spark, sf)
    return d.select("program_id", "slot", idl_hash_hex(F.col("idl_json")).alias("idl_hash"))
