"""Stand-in chain data derived from the driver's test tables.

The test data has no transactions, so each job derives them from the given
tables with Spark expressions (no driver-side rows), and the derived volume
grows with the tables:

* ``events``   -> one transaction per event (top-level instruction, event logs),
                  and an account-change stream for ``Customer`` accounts;
* ``lineitem`` -> one settlement transaction per line, with two inner (CPI)
                  instructions under top-level index 0;
* ``customer``, ``supplier``, ``part``, ``nation`` -> a raw account dump;
* ``part``     -> IDL documents: each part is a deployment of a brand's program.

Payloads are built byte-exact (discriminator + Borsh fields, base64 text) so
every decode path runs on real bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from progscan.functions.binary import le_hex, utf8_len_prefixed_hex
from progscan.functions.codec import (
    DISC_PREFIX_ACCOUNT,
    DISC_PREFIX_EVENT,
    DISC_PREFIX_INSTRUCTION,
    EVENT_LOG_PREFIX,
    discriminator_hex,
)
from progscan.plans.idl import Idl

PROGRAM_ID = "ActivityProg11111111111111111111111111111111"
ROUTER_ID = "RouterProg111111111111111111111111111111111"
BUDGET_ID = "FeeBudgetProg1111111111111111111111111111111"

EVENT_TYPES = ("view", "click", "signup", "purchase", "error")

_ACTIVITY_ARGS = [{"name": "amount", "type": "u64"}, {"name": "k", "type": "u16"},
                  {"name": "userId", "type": "u32"}]

ACTIVITY_IDL_DOC = {
    "version": "0.1.0",
    "name": "activity",
    "instructions": [
        {"name": t,
         "accounts": [{"name": "user", "isMut": True, "isSigner": True},
                      {"name": "authority", "isMut": False, "isSigner": False}],
         "args": _ACTIVITY_ARGS}
        for t in EVENT_TYPES
    ] + [
        {"name": "settle",
         "accounts": [{"name": "order", "isMut": True, "isSigner": False},
                      {"name": "supplier", "isMut": False, "isSigner": False}],
         "args": [{"name": "quantity", "type": "u64"}, {"name": "price", "type": "u64"},
                  {"name": "discount", "type": "u8"}]},
    ],
    "accounts": [
        {"name": "Customer", "type": {"kind": "struct", "fields": [
            {"name": "custkey", "type": "u64"}, {"name": "nationkey", "type": "u16"},
            {"name": "balance", "type": "i64"}, {"name": "segment", "type": "string"}]}},
        {"name": "Supplier", "type": {"kind": "struct", "fields": [
            {"name": "suppkey", "type": "u64"}, {"name": "nationkey", "type": "u16"},
            {"name": "balance", "type": "i64"}]}},
    ],
    "events": [
        {"name": "ValueRecorded", "fields": [
            {"name": "amount", "type": "u64"}, {"name": "userId", "type": "u32"}, {"name": "k", "type": "u16"}]},
        {"name": "PurchaseMade", "fields": [
            {"name": "amount", "type": "u64"}, {"name": "memo", "type": "string"}]},
    ],
}

ACTIVITY_IDL = Idl.from_dict(ACTIVITY_IDL_DOC)

# --------------------------------------------------------------- schemas ---

IX_STRUCT = T.StructType([
    T.StructField("programId", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("accounts", T.ArrayType(T.StringType())),
])
INNER_IX_STRUCT = T.StructType([
    T.StructField("programId", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("accounts", T.ArrayType(T.StringType())),
])
# Field names of a transaction record are fixed: they are the record format.
TX_SCHEMA = T.StructType([
    T.StructField("signature", T.StringType()),
    T.StructField("slot", T.LongType()),
    T.StructField("tx_index", T.IntegerType()),
    T.StructField("blockTime", T.LongType()),
    T.StructField("meta", T.StructType([
        T.StructField("err", T.StringType()),
        T.StructField("logMessages", T.ArrayType(T.StringType())),
        T.StructField("innerInstructions", T.ArrayType(T.StructType([
            T.StructField("index", T.IntegerType()),
            T.StructField("instructions", T.ArrayType(INNER_IX_STRUCT)),
        ]))),
    ])),
    T.StructField("transaction", T.StructType([
        T.StructField("message", T.StructType([
            T.StructField("instructions", T.ArrayType(IX_STRUCT)),
            T.StructField("accountKeys", T.ArrayType(T.StructType([T.StructField("pubkey", T.StringType())]))),
        ])),
    ])),
])

RAW_ACCOUNT_SCHEMA = "pubkey string, data binary, slot bigint"


# --------------------------------------------------------------- helpers ---

def epoch_seconds(ts: Column) -> Column:
    """Whole epoch seconds of a TIMESTAMP_NTZ, independent of the session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            ts.cast("timestamp_ntz"))


def cents(x: Column) -> Column:
    return F.round(x * F.lit(100)).cast("bigint")


def b64(hex_text: Column) -> Column:
    return F.base64(F.unhex(hex_text))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _empty_inner() -> Column:
    return F.array().cast(TX_SCHEMA["meta"].dataType["innerInstructions"].dataType)


def _records(out: DataFrame) -> DataFrame:
    """Columns of ``TX_SCHEMA``. Structs are built from parts of its types and not cast as a whole: Catalyst sees through a
    struct but not through its cast, and would build the whole record to test ``meta.err`` and once more to read it."""
    return out.select([F.col(f.name) if isinstance(f.dataType, T.StructType) else F.col(f.name).cast(f.dataType)
                       for f in TX_SCHEMA.fields])


# ------------------------------------------------------- transactions ------

def activity_columns(ev: DataFrame) -> DataFrame:
    """Typed source values of the activity transactions (what decoding must give back)."""
    return ev.select(
        F.concat(F.lit("sig"), F.col("event_id").cast("string")).alias("signature"),
        F.col("event_id").alias("slot"),
        F.lit(0).alias("tx_index"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("bigint"))
         .otherwise(epoch_seconds(F.col("ts"))).alias("block_time"),
        F.col("event_type"),
        F.col("user_id"),
        cents(F.col("value")).alias("amount"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _wanted(src: DataFrame, signatures: DataFrame | None) -> DataFrame:
    return src if signatures is None else src.join(signatures.select("signature"), "signature", "left_semi")


def activity_transactions(spark: SparkSession, sf_dir: str, by_slot: int | None = None,
                          signatures: DataFrame | None = None) -> DataFrame:
    """One transaction per ``events`` row (``error`` events are failed transactions).

    ``by_slot`` deals the source rows to that many tasks by slot, in order of their slots, before the nested records are
    built; with ``signatures`` they are only built for those."""
    src = _wanted(activity_columns(_read(spark, sf_dir, "events")), signatures)
    src = src if by_slot is None else src.repartition(by_slot, "slot").sortWithinPartitions("slot")
    ix_hex = F.concat(discriminator_hex(DISC_PREFIX_INSTRUCTION, F.col("event_type")),
                      le_hex(F.col("amount"), 8), le_hex(F.col("k"), 2), le_hex(F.col("user_id"), 4))
    ev_hex = F.concat(discriminator_hex(DISC_PREFIX_EVENT, F.lit("ValueRecorded")),
                      le_hex(F.col("amount"), 8), le_hex(F.col("user_id"), 4), le_hex(F.col("k"), 2))
    buy_hex = F.concat(discriminator_hex(DISC_PREFIX_EVENT, F.lit("PurchaseMade")),
                       le_hex(F.col("amount"), 8),
                       utf8_len_prefixed_hex(F.concat(F.lit("order-"), F.col("k").cast("string"))))
    et = F.col("event_type")
    invoke = F.concat(F.lit("Program "), F.lit(PROGRAM_ID), F.lit(" invoke [1]"))
    logs = F.filter(F.array(
        invoke,
        F.concat(F.lit("Program log: Instruction: "), F.initcap(et)),
        F.concat(F.lit(EVENT_LOG_PREFIX), b64(ev_hex)),
        F.when(et == "purchase", F.concat(F.lit(EVENT_LOG_PREFIX), b64(buy_hex))),
        # noise the event reader must skip without failing
        F.when(et == "click", F.lit(EVENT_LOG_PREFIX + "!!!not-valid-base64!!!")),
        F.when(et == "view", F.lit(EVENT_LOG_PREFIX + "//////////8=")),
        F.when(et == "signup", F.lit(EVENT_LOG_PREFIX + "AQIDBA==")),
        F.concat(F.lit("Program "), F.lit(PROGRAM_ID), F.lit(" success")),
    ), lambda x: x.isNotNull())
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    auth = F.concat(F.lit("auth_"), et)
    message = F.struct(
        F.array(
            F.struct(F.lit(BUDGET_ID).alias("programId"), F.lit("AsBcFQA=").alias("data"),
                     F.array().cast("array<string>").alias("accounts")),
            # the instruction lists its accounts in its own order (Q-2)
            F.struct(F.lit(PROGRAM_ID).alias("programId"), b64(ix_hex).alias("data"),
                     F.array(auth, user).alias("accounts")),
        ).alias("instructions"),
        F.array(F.struct(user.alias("pubkey")), F.struct(auth.alias("pubkey")),
                F.struct(F.lit(PROGRAM_ID).alias("pubkey"))).alias("accountKeys"),
    )
    meta = F.struct(
        F.when(et == "error", F.lit('{"InstructionError":[1,{"Custom":6001}]}')).alias("err"),
        logs.alias("logMessages"),
        _empty_inner().alias("innerInstructions"),
    )
    out = src.select(
        "signature", "slot", F.col("tx_index").cast("int").alias("tx_index"),
        F.col("block_time").alias("blockTime"), meta.alias("meta"),
        F.struct(message.alias("message")).alias("transaction"),
    )
    return _records(out)


def settlement_columns(li: DataFrame) -> DataFrame:
    return li.select(
        F.concat(F.lit("st"), F.col("l_orderkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string")).alias("signature"),
        F.col("l_orderkey").alias("slot"),
        F.col("l_linenumber").cast("int").alias("tx_index"),
        epoch_seconds(F.col("l_shipdate")).alias("block_time"),
        F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_returnflag"), F.col("l_linestatus"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        cents(F.col("l_extendedprice")).alias("price"),
        cents(F.col("l_discount")).alias("discount"),
        cents(F.col("l_tax")).alias("tax"),
    )


def settlement_transactions(spark: SparkSession, sf_dir: str, by_slot: int | None = None,
                            signatures: DataFrame | None = None) -> DataFrame:
    """One transaction per ``lineitem`` row; returned lines (flag ``R``) failed."""
    li = _read(spark, sf_dir, "lineitem")
    # the table's own columns are shuffled, which are fewer bytes than what is made of them
    li = li if by_slot is None else li.repartition(by_slot, "l_orderkey").sortWithinPartitions("l_orderkey")
    src = _wanted(settlement_columns(li), signatures)
    settle = discriminator_hex(DISC_PREFIX_INSTRUCTION, F.lit("settle"))
    first = F.concat(settle, le_hex(F.col("quantity"), 8), le_hex(F.col("price"), 8), le_hex(F.col("discount"), 1))
    second = F.concat(settle, le_hex(F.lit(0), 8), le_hex(F.col("tax"), 8), le_hex(F.lit(0), 1))
    order = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    supp = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    inner = F.array(F.struct(
        F.lit(0).alias("index"),
        # inner instructions list their accounts in their own order, too
        F.array(*[F.struct(F.lit(PROGRAM_ID).alias("programId"), b64(h).alias("data"), F.array(supp, order).alias("accounts"))
                  for h in (first, second)]).alias("instructions"),
    ))
    meta = F.struct(
        F.when(F.col("l_returnflag") == "R", F.lit('{"InstructionError":[0,"InvalidAccountData"]}')).alias("err"),
        F.array(F.concat(F.lit("Program "), F.lit(ROUTER_ID), F.lit(" invoke [1]")),
                F.concat(F.lit("Program "), F.lit(PROGRAM_ID), F.lit(" invoke [2]")),
                F.concat(F.lit("Program "), F.lit(ROUTER_ID), F.lit(" success"))).alias("logMessages"),
        inner.alias("innerInstructions"),
    )
    message = F.struct(
        F.array(F.struct(F.lit(ROUTER_ID).alias("programId"), F.lit("AQ==").alias("data"),
                         F.array(order).alias("accounts"))).alias("instructions"),
        F.array(F.struct(order.alias("pubkey")), F.struct(supp.alias("pubkey"))).alias("accountKeys"),
    )
    out = src.select("signature", "slot", "tx_index", F.col("block_time").alias("blockTime"),
                     meta.alias("meta"), F.struct(message.alias("message")).alias("transaction"))
    return _records(out)


def all_transactions(spark: SparkSession, sf_dir: str, by_slot: int | None = None,
                     signatures: DataFrame | None = None) -> DataFrame:
    return activity_transactions(spark, sf_dir, by_slot, signatures).unionByName(
        settlement_transactions(spark, sf_dir, by_slot, signatures))


def signature_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chain lists for the program: every settlement transaction."""
    return settlement_columns(_read(spark, sf_dir, "lineitem")).select("signature", "slot")


# ------------------------------------------------------------- accounts ----

def customer_payload(custkey: Column, nationkey: Column, balance: Column, segment: Column) -> Column:
    return F.unhex(F.concat(discriminator_hex(DISC_PREFIX_ACCOUNT, F.lit("Customer")),
                            le_hex(custkey, 8), le_hex(nationkey, 2), le_hex(balance, 8),
                            utf8_len_prefixed_hex(segment)))


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account dump: customers, suppliers, parts (unknown type) and nations (too short)."""
    cust = _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("pubkey"),
        customer_payload(F.col("c_custkey"), F.col("c_nationkey"), cents(F.col("c_acctbal")),
                         F.col("c_mktsegment")).alias("data"),
        F.col("c_custkey").alias("slot"))
    supp = _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("pubkey"),
        F.unhex(F.concat(discriminator_hex(DISC_PREFIX_ACCOUNT, F.lit("Supplier")),
                         le_hex(F.col("s_suppkey"), 8), le_hex(F.col("s_nationkey"), 2),
                         le_hex(cents(F.col("s_acctbal")), 8))).alias("data"),
        F.col("s_suppkey").alias("slot"))
    part = _read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pubkey"),
        F.unhex(F.concat(discriminator_hex(DISC_PREFIX_ACCOUNT, F.lit("Part")),
                         le_hex(F.col("p_size"), 4))).alias("data"),
        F.col("p_partkey").alias("slot"))
    nation = _read(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("pubkey"),
        F.unhex(le_hex(F.col("n_regionkey"), 4)).alias("data"),
        F.col("n_nationkey").cast("bigint").alias("slot"))
    return cust.unionByName(supp).unionByName(part).unionByName(nation)


def account_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-change observations: every event rewrites customer ``c<user_id>``.

    Columns: pubkey, slot, seq (arrival order inside the slot), data.
    """
    src = activity_columns(_read(spark, sf_dir, "events"))
    return src.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("pubkey"),
        F.col("slot"),
        F.lit(0).cast("bigint").alias("seq"),
        customer_payload(F.col("user_id"), F.col("k"), F.col("amount"), F.col("event_type")).alias("data"),
    )


# ------------------------------------------------------------ IDL docs -----

def idl_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDL documents, one deployment per ``part`` row.

    program_id = brand, slot = part key; the document holds ``initialize`` plus
    an instruction named after the part type, whose args grow with the size.
    Columns: program_id, slot, idl_json.
    """
    p = _read(spark, sf_dir, "part")
    prog = F.regexp_replace(F.lower(F.col("p_brand")), "[^a-z0-9]", "_")
    ixname = F.lower(F.col("p_type"))
    args = F.concat(
        F.lit('[{"name":"size","type":"u32"},{"name":"price","type":"u64"}'),
        F.when(F.col("p_size") > 25, F.lit(',{"name":"label","type":"string"}')).otherwise(F.lit("")),
        F.when(F.col("p_size") > 40, F.lit(',{"name":"tags","type":{"vec":"u8"}}')).otherwise(F.lit("")),
        F.lit("]"))
    doc = F.concat(
        F.lit('{"version":"0.'), F.col("p_size").cast("string"), F.lit('.0","name":"'), prog,
        F.lit('","instructions":[{"name":"initialize","accounts":[{"name":"authority","isMut":true,'
              '"isSigner":true}],"args":[{"name":"bump","type":"u8"}]},{"name":"'), ixname,
        F.lit('","accounts":[{"name":"owner","isMut":true,"isSigner":true}],"args":'), args,
        F.lit('}],"accounts":[{"name":"State","type":{"kind":"struct","fields":[{"name":"total","type":"u64"},'
              '{"name":"maxSize","type":{"option":{"option":"u16"}}}]}}],'
              '"events":[{"name":"Resized","fields":[{"name":"size","type":"u32"}]}]}'))
    return p.select(prog.alias("program_id"), F.col("p_partkey").alias("slot"), doc.alias("idl_json"))
