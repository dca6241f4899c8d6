"""Transactions -> instruction rows and event rows (one pass, no driver loops).

Plan shape: scan -> filter (ok, program) -> posexplode -> lenient base64 ->
broadcast join on the 8-byte discriminator against the IDL's definition
table (bounded by the number of definitions in one document) -> staged
decode projection. No shuffle until the insert-ignore step in ``store``.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.functions.codec import EVENT_LOG_PREFIX, lenient_unbase64
from progscan.plans.decode import decode_fields, is_placed, json_object
from progscan.plans.idl import Field, Idl, column_name

# Ordering key inside a slot: transaction, depth, outer position, inner position.
# id = ((tx_index * 2 + cpi_depth) * 4096 + pos1) * 4096 + pos2 -- unique per slot,
# follows the order the reference inserts rows in, and needs no shuffle.
POS_RADIX = 4096

DEFS_SCHEMA = "name string, disc string"


def ok_transactions(tx: DataFrame) -> DataFrame:
    """C-1: keep transactions that have ``meta`` and no ``meta.err``."""
    return tx.where(F.col("meta").isNotNull() & F.col("meta.err").isNull())


def _keys(tx_col: str = "transaction") -> Column:
    return F.transform(F.col(f"{tx_col}.message.accountKeys"), lambda k: F.coalesce(k["pubkey"], F.lit("")))


def _tx_order(tx_index: str = "tx_index", signature: str = "signature") -> Column:
    """Place of a transaction in its slot. Records without one (plain RPC records) get 37 bits of
    the signature's hash, which needs no shuffle and is the same in every batch; two of a slot may
    still meet, which pages resolve by signature (see ``query.page``)."""
    return F.coalesce(F.col(tx_index).cast("bigint"), F.pmod(F.xxhash64(signature), F.lit(1 << 37)))


def _row_id(tx_order: Column, depth, pos1: Column, pos2: Column) -> Column:
    """Positions beyond the radix (far more than a transaction can hold) share the last place; such rows of one
    transaction are told apart by their other columns (``arrival_order``), those of one table by signature."""
    last = F.lit(POS_RADIX - 1)
    return ((tx_order * 2 + depth) * POS_RADIX + F.least(pos1, last)) * POS_RADIX + F.least(pos2, last)


def program_instructions(tx: DataFrame, program_id: str) -> DataFrame:
    """D-1, D-2, C-2, H-4: top-level and inner (CPI) rows of the ok transactions, in one scan.

    Both levels are concatenated inside the row and filtered to the program's
    non-empty instructions before anything is exploded; the account keys are
    attached to the rows that remain. Inner rows carry ``sig:cpi:<index>`` and
    their own account list where the record has one.
    """
    own = lambda x: (x["programId"] == F.lit(program_id)) & (x["data"] != F.lit(""))
    inner_fields = tx.schema["meta"].dataType["innerInstructions"].dataType.elementType["instructions"] \
        .dataType.elementType.names

    def row(x: Column, depth: int, pos1: Column, pos2: Column, index: Column, accounts: Column) -> Column:
        return F.struct(F.lit(depth).alias("cpi_depth"), index.cast("int").alias("parent_ix_index"),
                        pos1.cast("int").alias("pos1"), pos2.cast("int").alias("pos2"),
                        x["programId"].alias("programId"), x["data"].alias("data"), accounts.alias("ix_accounts"))

    none = F.lit(None).cast("array<string>")
    # a null array has no rows; it must not make flatten() or concat() null, which would lose its neighbours
    top = F.transform(F.coalesce(F.col("transaction.message.instructions"), F.array()),
                      lambda x, i: row(x, 0, i, F.lit(0), F.lit(None), x["accounts"]))
    inner = F.flatten(F.transform(F.coalesce(F.col("meta.innerInstructions"), F.array()), lambda g, gi: F.transform(
        F.coalesce(g["instructions"], F.array()),
        lambda x, i: row(x, 1, gi, i, g["index"], x["accounts"] if "accounts" in inner_fields else none))))
    both = F.concat(F.filter(top, own), F.filter(inner, own))
    base = ok_transactions(tx).select("signature", "slot", "tx_index", F.col("blockTime").alias("block_time"),
                                      _keys().alias("account_keys"), F.explode(both).alias("ix"))
    depth = F.col("ix.cpi_depth")
    return base.select(
        F.when(depth == 0, F.col("signature")).otherwise(
            F.concat(F.col("signature"), F.lit(":cpi:"), F.col("ix.parent_ix_index").cast("string"))).alias("signature"),
        "slot", "tx_index", "block_time", depth.alias("cpi_depth"), F.col("ix.parent_ix_index").alias("parent_ix_index"),
        _row_id(_tx_order(), depth, F.col("ix.pos1"), F.col("ix.pos2")).alias("id"),
        F.col("ix.data").alias("data"), "account_keys", F.col("ix.ix_accounts").alias("ix_accounts"))


def top_level_instructions(tx: DataFrame, program_id: str) -> DataFrame:
    """D-1: the top-level rows of ``program_instructions``."""
    return program_instructions(tx, program_id).where("cpi_depth = 0")


def inner_instructions(tx: DataFrame, program_id: str) -> DataFrame:
    """D-2: the inner rows of ``program_instructions``."""
    return program_instructions(tx, program_id).where("cpi_depth = 1")


def definitions(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Small literal table (name, disc) of one IDL's definitions, for a broadcast join."""
    return spark.createDataFrame(pairs or [], DEFS_SCHEMA)


def match_definitions(rows: DataFrame, data_col: Column, defs: DataFrame, name_col: str,
                      encoding: str = "base64", version: Column | None = None) -> DataFrame:
    """E-5 + C-4 + E-4/H-1: text -> bytes, length >= 8, discriminator lookup.

    ``encoding="base58"`` reads the payload the way parsed-transaction RPC
    returns it (Q-1; Arrow-batched helper, no SQL form). ``defs`` is one IDL's
    definition list, so its size is bounded by the document, not by the data;
    broadcasting it is always safe. With a ``version`` (an expression over the
    rows) the definitions carry a ``version`` column that must equal it.
    """
    if encoding == "base58":
        from progscan.functions.base58 import base58_decode

        raw_col = base58_decode(data_col)
    else:
        raw_col = lenient_unbase64(data_col)
    # C-4 (< 8 bytes never match) is implied by the join: a shorter payload yields
    # fewer than 16 hex digits. No separate filter, so the bytes are decoded once
    # (a pushed-down filter would re-evaluate the base64 decode below the projection).
    raw = rows.withColumn("raw", raw_col)
    # never null, so that the join needs no null test, which would be pushed down and decode every payload once more
    raw = raw.withColumn("disc", F.coalesce(F.lower(F.hex(F.substring("raw", 1, 8))), F.lit("")))
    d = defs.withColumnRenamed("name", name_col)
    on = ["disc"]
    if version is not None:
        raw, on = raw.withColumn("version", version), ["disc", "version"]
    return raw.join(F.broadcast(d), on, "inner").drop(*on)


def decode_by_definition(df: DataFrame, name_col: str, defs: "OrderedDict[str, list[Field]]",
                         prefix: str, js_col: str | None = None, registry=None) -> tuple[DataFrame, list[str]]:
    """Decode each row with the field list of its definition, in one projection.

    Definitions that share a field layout share one decode; each output
    column (``prefix`` + normalised field name) picks the value of the row's
    definition. Returns the frame and the output column names in order.
    """
    layouts: "OrderedDict[str, list[str]]" = OrderedDict()
    for name, fields in defs.items():
        layouts.setdefault(json.dumps([f.type for f in fields], sort_keys=True), []).append(name)
    out_cols: "OrderedDict[str, OrderedDict[str, list[str]]]" = OrderedDict()
    objects: list[tuple[str, Column]] = []
    for li, (key, names) in enumerate(layouts.items()):
        fields = defs[names[0]]
        tmp = [f"__l{li}_{i}" for i in range(len(fields))]
        frags = [f"__lj{li}_{i}" for i in range(len(fields))] if js_col else None
        if registry is None and is_placed(fields) and (js_col is None or len(names) == 1):
            # each value is named once below and only there computed, for the rows of its definitions
            df = decode_fields(df, "raw", fields, tmp, js_values=frags)
        else:
            raw_tmp = f"__raw{li}"
            df = df.withColumn(raw_tmp, F.when(F.col(name_col).isin(names), F.col("raw")))
            df = decode_fields(df, raw_tmp, fields, tmp, registry=registry, js_values=frags)
            df = df.drop(raw_tmp)
        for nm in names:
            for f, t in zip(defs[nm], tmp):
                _note_source(out_cols.setdefault(column_name(prefix, f.name), OrderedDict()), t, nm)
            if js_col:
                # same layout, own field names: each definition builds its own object
                objects.append((nm, json_object([f.name for f in defs[nm]], frags)))
    final = {col: _by_name(name_col, [(names, F.col(t)) for t, names in srcs.items()]) for col, srcs in out_cols.items()}
    if js_col:
        expr = None
        for nm, c in objects:
            expr = F.when(F.col(name_col) == nm, c) if expr is None else expr.when(F.col(name_col) == nm, c)
        final[js_col] = expr if expr is not None else F.lit(None).cast("string")
    df = df.withColumns(final) if final else df
    drop = [c for c in df.columns if c.startswith("__l")]
    return df.drop(*drop), list(out_cols.keys())


def _note_source(sources: OrderedDict, source, name: str) -> None:
    """Note where a definition's value of a column comes from; the first of several counts."""
    if not any(name in names for names in sources.values()):
        sources.setdefault(source, []).append(name)


def _by_name(name_col: str, values: list[tuple[list[str], Column]]) -> Column:
    """The value of the row's definition."""
    expr = None
    for names, v in values:
        cond = F.col(name_col).isin(names)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr


# More distinct argument layouts than this are decoded in groups (see below).
MAX_LAYOUTS_PER_PROJECTION = 12


def decode_instructions(tx: DataFrame, idl: Idl, program_id: str, accounts: str = "transaction",
                        encoding: str = "base64", name_case: str = "as_is", mode: str = "stored",
                        max_layouts: int = MAX_LAYOUTS_PER_PROJECTION, version: Column | None = None,
                        pairs: list[tuple] | None = None, pick: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Instruction rows of ``program_id`` decoded with ``idl`` (all types in one frame).

    Columns: ix_name, id, signature, slot, block_time, cpi_depth, parent_ix_index,
    account_* (positional, D-4), arg_* (stored text, E-19/D-5).
    ``accounts="instruction"`` maps the instruction's own key list instead of the
    transaction-level keys (Q-2).

    An IDL with many distinct argument layouts would make one huge projection
    (generated code past the JIT's limits). Beyond ``max_layouts`` the matched
    rows are written once, partitioned by instruction, to the shared checkpoint
    folder; each group of layouts then decodes only its own partitions and the
    groups are unioned -- one extra write, still one read of every row.

    ``version`` and ``pairs`` ((name, discriminator, version) triples) are those
    of ``versions.decode_as_of``. ``pick`` takes the matched rows (ix_name and the
    columns up to parent_ix_index, and the payload) and returns those to decode.
    """
    spark = tx.sparkSession
    rows = program_instructions(tx, program_id)
    if version is None:
        defs = definitions(spark, idl.instruction_discriminators(name_case))
    else:
        defs = spark.createDataFrame(pairs, DEFS_SCHEMA + ", version int")
    m = match_definitions(rows, F.col("data"), defs, "ix_name", encoding, version)
    m = pick(m) if pick else m
    registry = idl.type_def if mode == "typed" else None
    all_defs = OrderedDict((ix.name, list(ix.args)) for ix in idl.instructions)
    groups = _layout_groups(all_defs, max_layouts)
    if len(groups) == 1:
        m, arg_cols = decode_by_definition(m, "ix_name", all_defs, "arg_", registry=registry)
    else:
        from progscan.session import scratch_dir

        path = scratch_dir(spark, "matched_ix")
        m.write.partitionBy("ix_name").parquet(path)
        parts, arg_cols = [], []
        for names in groups:
            sub = spark.read.parquet(path).where(F.col("ix_name").isin(names))  # partition pruning
            d, cols = decode_by_definition(sub, "ix_name", OrderedDict((n, all_defs[n]) for n in names), "arg_",
                                           registry=registry)
            parts.append(d)
            arg_cols += [c for c in cols if c not in arg_cols]
        m = parts[0]
        for p in parts[1:]:
            m = m.unionByName(p, allowMissingColumns=True)
    keys = F.col("account_keys") if accounts == "transaction" else F.coalesce(F.col("ix_accounts"), F.col("account_keys"))
    acct: "OrderedDict[str, OrderedDict[int, list[str]]]" = OrderedDict()
    for ix in idl.instructions:
        for i, a in enumerate(ix.accounts):
            _note_source(acct.setdefault(column_name("account_", a.name), OrderedDict()), i, ix.name)
    acc_exprs = {col: _by_name("ix_name", [(names, F.get(keys, i)) for i, names in srcs.items()])
                 for col, srcs in acct.items()}
    m = m.withColumns(acc_exprs) if acc_exprs else m
    base = ["ix_name", "id", "signature", "slot", "block_time", "cpi_depth", "parent_ix_index"]
    return m.select(*base, *acc_exprs.keys(), *arg_cols)


def _layout_groups(defs: "OrderedDict[str, list[Field]]", max_layouts: int) -> list[list[str]]:
    """Definition names grouped so that each group holds at most ``max_layouts`` layouts."""
    by_layout: "OrderedDict[str, list[str]]" = OrderedDict()
    for name, fields in defs.items():
        by_layout.setdefault(json.dumps([f.type for f in fields], sort_keys=True), []).append(name)
    layouts = list(by_layout.values())
    return [sum(layouts[i:i + max_layouts], []) for i in range(0, len(layouts), max(1, max_layouts))] or [[]]


def instruction_table(decoded: DataFrame, idl: Idl, ix_name: str, mode: str = "stored") -> DataFrame:
    """D-6: the stored table of one instruction (its own columns only).

    ``mode="typed"`` converts each argument from its stored text to the Spark
    type of its IDL type (u64 -> decimal(20,0), vec -> array, ...)."""
    from progscan.plans.decode import typed_column

    ix = idl.instruction(ix_name)
    cols = [F.col(c) for c in ("id", "signature", "slot", "block_time", "cpi_depth", "parent_ix_index")]
    cols += [F.col(column_name("account_", a.name)) for a in ix.accounts]
    for f in ix.args:
        c = column_name("arg_", f.name)
        cols.append(typed_column(F.col(c), f.type, idl.type_def).alias(c) if mode == "typed" else F.col(c))
    return decoded.where(F.col("ix_name") == ix_name).select(*cols)


def decode_events(tx: DataFrame, idl: Idl) -> DataFrame:
    """D-3 + C-3 + E-20: events from ``Program data:`` logs of ok transactions.

    Columns: id, event_name, signature, slot, block_time, data (JSON text).
    """
    spark = tx.sparkSession
    ok = ok_transactions(tx)
    logs = ok.select("signature", "slot", "tx_index", F.col("blockTime").alias("block_time"),
                     F.posexplode(F.col("meta.logMessages")).alias("pos", "log"))
    logs = logs.where(F.col("log").startswith(EVENT_LOG_PREFIX))
    payload = F.trim(F.substr(F.col("log"), F.lit(len(EVENT_LOG_PREFIX) + 1)))
    defs = definitions(spark, idl.event_discriminators())
    m = match_definitions(logs, payload, defs, "event_name")
    m, _ = decode_by_definition(m, "event_name", OrderedDict((e.name, list(e.fields)) for e in idl.events),
                                "f_", js_col="data")
    return m.select(
        (_tx_order() * (POS_RADIX * POS_RADIX) + F.col("pos")).alias("id"),
        "event_name", "signature", "slot", "block_time", "data")


def decode_accounts(accounts: DataFrame, idl: Idl, type_names: list[str] | None = None,
                    unknown: bool = False) -> DataFrame:
    """E-22 + A-8: decode an account dump by its 8-byte type prefix, all types in one pass.

    Columns: account_type, pubkey, slot, <normalised field columns>, data (JSON text).
    ``unknown`` keeps accounts of no known type: without a type, data holds the
    bytes as ``{"raw_hex": ...}``. Data shorter than a prefix is skipped.
    """
    spark = accounts.sparkSession
    pairs = [(n, d) for n, d in idl.account_discriminators() if type_names is None or n in type_names]
    defs = definitions(spark, pairs)
    raw = accounts.withColumnRenamed("data", "raw_bytes")
    if "disc" not in raw.columns:  # stored dumps carry it (see accounts.with_disc)
        raw = raw.where(F.length("raw_bytes") >= 8)
        raw = raw.withColumn("disc", F.lower(F.hex(F.substring("raw_bytes", 1, 8))))
    elif unknown:
        raw = raw.where(F.length("raw_bytes") >= 8)
    m = raw.join(F.broadcast(defs.withColumnRenamed("name", "account_type")), "disc", "left" if unknown else "inner").drop("disc")
    m = m.withColumnRenamed("raw_bytes", "raw")
    accs = OrderedDict((a.name, list(a.fields)) for a in idl.accounts if a.name in dict(pairs))
    m, cols = decode_by_definition(m, "account_type", accs, "", js_col="data")
    if unknown:
        hexed = F.concat(F.lit('{"raw_hex":"'), F.lower(F.hex("raw")), F.lit('"}'))
        m = m.withColumn("data", F.when(F.col("account_type").isNull(), hexed).otherwise(F.col("data")))
    keep = [c for c in accounts.columns if c not in ("data", "disc")]
    return m.select("account_type", *keep, *cols, "data")


def event_table(events: DataFrame, idl: Idl, event_name: str, mode: str = "stored") -> DataFrame:
    """D-8: the rows of one event type; ``mode="typed"`` parses the JSON payload into a
    struct of the event's fields (u64 stays text, as in the payload)."""
    from pyspark.sql import types as T

    ev = next(e for e in idl.events if e.name == event_name)
    rows = events.where(F.col("event_name") == event_name)
    if mode != "typed":
        return rows
    from progscan.plans.decode import spark_type

    def json_type(t):
        st = spark_type(t, idl.type_def)
        # 64/128-bit integers and keys are JSON strings in the payload
        return T.StringType() if isinstance(st, T.DecimalType) or t in ("i64", "u128", "i128") else st

    schema = T.StructType([T.StructField(f.name, json_type(f.type)) for f in ev.fields])
    return rows.withColumn("data", F.from_json("data", schema))


def account_table(decoded: DataFrame, idl: Idl, type_name: str, mode: str = "stored") -> DataFrame:
    """Snapshot/history table of one account type (``acc_<program>_<type>`` columns)."""
    from progscan.plans.decode import typed_column

    acc = idl.account(type_name)
    keep = [c for c in ("pubkey", "slot", "seq") if c in decoded.columns]
    cols = [F.col(c) for c in keep]
    for f in acc.fields:
        c = column_name("", f.name)
        cols.append(typed_column(F.col(c), f.type, idl.type_def).alias(c) if mode == "typed" else F.col(c))
    return decoded.where(F.col("account_type") == type_name).select(*cols)
