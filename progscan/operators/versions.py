"""IDL documents as data: registry, history, diff, additive schema, as-of decode.

Documents are parsed with ``from_json`` (argument types kept as raw JSON
text) and exploded on the executors; nothing is collected to the driver.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from progscan.functions.codec import idl_hash_hex, normalise_name
from progscan.operators.store import first_per_key, insert_ignore
from progscan.plans.idl import Idl, defined_name

_ACC = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("isMut", T.BooleanType()),
                                 T.StructField("isSigner", T.BooleanType())]))
_ARGS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))
IDL_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("instructions", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("accounts", _ACC), T.StructField("args", _ARGS)]))),
    T.StructField("accounts", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StructType([T.StructField("kind", T.StringType()),
                                            T.StructField("fields", _ARGS)]))]))),
    T.StructField("events", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("fields", _ARGS)]))),
])

# fixed leading / trailing columns of an instruction table (name, storage class)
IX_FIXED_HEAD = [("id", "INTEGER"), ("signature", "TEXT"), ("slot", "INTEGER"), ("block_time", "INTEGER"),
                 ("cpi_depth", "INTEGER"), ("parent_ix_index", "INTEGER")]
IX_FIXED_TAIL = [("indexed_at", "INTEGER")]


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("idl_hash", idl_hash_hex(F.col("idl_json")))


def register(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """I-3: new registry rows -- idempotent on (program_id, idl_hash), first by slot."""
    d = with_hash(docs).select("program_id", "idl_hash", "slot", "idl_json")
    return insert_ignore(d, ["program_id", "idl_hash"], ["slot", "idl_json"], existing)


def upgrades(docs: DataFrame) -> DataFrame:
    """I-4: deployments whose document hash differs from the program's previous deployment
    (the first deployment of a program counts as an upgrade from nothing)."""
    w = Window.partitionBy("program_id").orderBy("slot")
    d = with_hash(docs).select("program_id", "slot", "idl_hash")
    d = d.withColumn("prev_hash", F.lag("idl_hash").over(w))
    return d.where(F.col("prev_hash").isNull() | (F.col("prev_hash") != F.col("idl_hash")))


def history(registry: DataFrame) -> DataFrame:
    """I-6: versions of each program in registration order, numbered."""
    w = Window.partitionBy("program_id").orderBy("slot", "idl_hash")
    return registry.withColumn("version_no", F.row_number().over(w))


def parse(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc", F.from_json(F.col("idl_json"), IDL_SCHEMA))


def instruction_args(docs: DataFrame) -> DataFrame:
    """(program_id, slot, ix_name, arg_pos, arg_name, arg_type) for every document.

    Instructions without args still yield one row with NULL arg fields."""
    p = parse(docs)
    ix = p.select("program_id", "slot", F.explode("doc.instructions").alias("ix"))
    return ix.select("program_id", "slot", F.col("ix.name").alias("ix_name"),
                     F.explode_outer(F.col("ix.args")).alias("arg")) \
        .select("program_id", "slot", "ix_name", F.col("arg.name").alias("arg_name"),
                F.col("arg.type").alias("arg_type"))


def diff(registry: DataFrame) -> DataFrame:
    """H-5: per consecutive pair of versions, new instruction names and new args
    of instructions present in both. Columns: program_id, slot, change, ix_name, arg_name."""
    w = Window.partitionBy("program_id").orderBy("slot", "idl_hash")
    v = registry.select("program_id", "slot", "idl_json", F.lag("slot").over(w).alias("prev_slot"))
    pairs = v.where(F.col("prev_slot").isNotNull()).select("program_id", "slot", "prev_slot")
    cur = instruction_args(registry)
    prev = cur.select("program_id", F.col("slot").alias("prev_slot"), "ix_name", "arg_name")
    cur = cur.join(pairs, ["program_id", "slot"], "inner")
    prev_ix = prev.select("program_id", "prev_slot", "ix_name").distinct()
    new_ix = cur.select("program_id", "slot", "prev_slot", "ix_name").distinct() \
        .join(prev_ix, ["program_id", "prev_slot", "ix_name"], "left_anti")
    shared = cur.join(prev_ix, ["program_id", "prev_slot", "ix_name"], "left_semi").where(F.col("arg_name").isNotNull())
    new_args = shared.join(prev.where(F.col("arg_name").isNotNull()),
                           ["program_id", "prev_slot", "ix_name", "arg_name"], "left_anti")
    a = new_ix.select("program_id", "slot", F.lit("instruction").alias("change"), "ix_name",
                      F.lit(None).cast("string").alias("arg_name"))
    b = new_args.select("program_id", "slot", F.lit("arg").alias("change"), "ix_name", "arg_name")
    return a.unionByName(b)


# The scalar types that are stored as TEXT, as are all composite ones; other scalars are INTEGER.
TEXT_SCALARS = ("string", "publicKey", "u64", "i64", "u128", "i128")


def storage_type(t: Column) -> Column:
    """§1.3 storage class of the raw JSON text of an IDL type: that of what its options, however nested, hold."""
    plain = F.trim(F.regexp_replace(t, r'\{\s*"option"\s*:|\}(?=[\s}]*$)|"', ""))
    scalar = ~F.regexp_like(F.regexp_replace(t, r'"option"\s*:', ""), F.lit(r'"\s*:'))
    return F.when(scalar & ~plain.isin(*TEXT_SCALARS), F.lit("INTEGER")).otherwise(F.lit("TEXT"))


def schema_tables(docs: DataFrame) -> DataFrame:
    """I-1: one row per (table, ordinal, column, storage type) for each document's
    instruction tables. Columns: program_id, slot, table_name, ordinal, column_name, storage_type."""
    p = parse(docs)
    ix = p.select("program_id", "slot", F.col("doc.name").alias("prog"), F.posexplode("doc.instructions")
                  .alias("ix_pos", "ix"))
    table = normalise_name(F.concat(F.lit("ix_"), F.col("prog"), F.lit("_"), F.col("ix.name")))
    n_acc = F.size(F.coalesce(F.col("ix.accounts"), F.array().cast(_ACC)))
    head = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column_name"), F.lit(t).alias("storage_type"))
                     for i, (n, t) in enumerate(IX_FIXED_HEAD)])
    accs = F.transform(F.coalesce(F.col("ix.accounts"), F.array().cast(_ACC)), lambda a, i: F.struct(
        (F.lit(len(IX_FIXED_HEAD)) + i).alias("ordinal"),
        normalise_name(F.concat(F.lit("account_"), a["name"])).alias("column_name"),
        F.lit("TEXT").alias("storage_type")))
    args = F.transform(F.coalesce(F.col("ix.args"), F.array().cast(_ARGS)), lambda a, i: F.struct(
        (F.lit(len(IX_FIXED_HEAD)) + n_acc + i).alias("ordinal"),
        normalise_name(F.concat(F.lit("arg_"), a["name"])).alias("column_name"),
        storage_type(a["type"]).alias("storage_type")))
    n_args = F.size(F.coalesce(F.col("ix.args"), F.array().cast(_ARGS)))
    tail = F.array(*[F.struct((F.lit(len(IX_FIXED_HEAD) + i) + n_acc + n_args).alias("ordinal"),
                              F.lit(n).alias("column_name"), F.lit(t).alias("storage_type"))
                     for i, (n, t) in enumerate(IX_FIXED_TAIL)])
    cols = F.concat(head, accs, args, tail)
    return ix.select("program_id", "slot", table.alias("table_name"), F.explode(cols).alias("c")) \
        .select("program_id", "slot", "table_name", F.col("c.ordinal").cast("int").alias("ordinal"),
                "c.column_name", "c.storage_type")


ACC_FIXED_HEAD = [("id", "INTEGER"), ("pubkey", "TEXT"), ("slot", "INTEGER")]
ACC_FIXED_TAIL = [("updated_at", "INTEGER")]


def account_schema_tables(docs: DataFrame) -> DataFrame:
    """I-1 for account types: ``acc_<program>_<type>`` columns (id, pubkey, slot,
    the type's fields, updated_at). Same columns as ``schema_tables``."""
    p = parse(docs)
    acc = p.select("program_id", "slot", F.col("doc.name").alias("prog"), F.explode("doc.accounts").alias("acc"))
    table = normalise_name(F.concat(F.lit("acc_"), F.col("prog"), F.lit("_"), F.col("acc.name")))
    flds = F.coalesce(F.col("acc.type.fields"), F.array().cast(_ARGS))
    head = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column_name"), F.lit(t).alias("storage_type"))
                     for i, (n, t) in enumerate(ACC_FIXED_HEAD)])
    body = F.transform(flds, lambda a, i: F.struct(
        (F.lit(len(ACC_FIXED_HEAD)) + i).alias("ordinal"), normalise_name(a["name"]).alias("column_name"),
        storage_type(a["type"]).alias("storage_type")))
    tail = F.array(*[F.struct((F.lit(len(ACC_FIXED_HEAD) + i) + F.size(flds)).alias("ordinal"),
                              F.lit(n).alias("column_name"), F.lit(t).alias("storage_type"))
                     for i, (n, t) in enumerate(ACC_FIXED_TAIL)])
    return acc.select("program_id", "slot", table.alias("table_name"), F.explode(F.concat(head, body, tail)).alias("c")) \
        .select("program_id", "slot", "table_name", F.col("c.ordinal").cast("int").alias("ordinal"),
                "c.column_name", "c.storage_type")


def evolve(registry: DataFrame, include_accounts: bool = True) -> DataFrame:
    """I-5: additive migration -- every (table, column) ever declared, with the slot of
    the version that first declared it; nothing is dropped."""
    t = schema_tables(registry)
    if include_accounts:
        # unlike the reference's migration (instructions only), account fields evolve too
        t = t.unionByName(account_schema_tables(registry))
    return t.groupBy("program_id", "table_name", "column_name").agg(
        F.min("slot").alias("first_slot"), F.min("storage_type").alias("storage_type"))


def catalog(docs: DataFrame) -> DataFrame:
    """D-7: program, version, and per instruction its account and arg counts."""
    p = parse(docs)
    ix = p.select("program_id", "slot", F.col("doc.version").alias("version"), F.explode("doc.instructions").alias("ix"))
    return ix.select("program_id", "slot", "version", F.col("ix.name").alias("ix_name"),
                     F.size(F.coalesce("ix.accounts", F.array().cast(_ACC))).alias("n_accounts"),
                     F.size(F.coalesce("ix.args", F.array().cast(_ARGS))).alias("n_args"))


def listing(docs: DataFrame) -> DataFrame:
    """D-7: the full listing of each document: one row per instruction, account type and event.

    Columns: program_id, slot, version, kind, name, accounts (names in order,
    with ``mut`` / ``signer``), fields (``name: type`` in order, the type as
    its JSON text).
    """
    text = lambda fs: F.transform(F.coalesce(fs, F.array().cast(_ARGS)),
                                  lambda f: F.concat(f["name"], F.lit(": "), f["type"]))
    flags = lambda a: F.concat_ws(" ", a["name"], F.when(a["isMut"], "mut"), F.when(a["isSigner"], "signer"))
    none = F.array().cast("array<string>")

    def entry(kind: str, name, accounts, fields):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), accounts.alias("accounts"), fields.alias("fields"))

    def each(column: str, of):
        dtype = IDL_SCHEMA[column].dataType
        return F.transform(F.coalesce(F.col(f"doc.{column}"), F.array().cast(dtype)), of)

    entries = F.concat(
        each("instructions", lambda x: entry("instruction", x["name"], F.transform(
            F.coalesce(x["accounts"], F.array().cast(_ACC)), flags), text(x["args"]))),
        each("accounts", lambda x: entry("account", x["name"], none, text(x["type"]["fields"]))),
        each("events", lambda x: entry("event", x["name"], none, text(x["fields"]))))
    return parse(docs).select("program_id", "slot", F.col("doc.version").alias("version"), F.explode(entries).alias("e")) \
        .select("program_id", "slot", "version", "e.*")


def latest(registry: DataFrame) -> DataFrame:
    """Current version of each program (partial aggregation, not a window)."""
    return first_per_key(registry, ["program_id"], ["slot", "idl_hash"], last=True)


def as_of(rows: DataFrame, registry: DataFrame, bucket_slots: int) -> DataFrame:
    """L-3: attach to each row (program_id, slot) the version valid at its slot:
    the latest registered version with ``version slot <= row slot`` (the largest
    hash among versions of one slot).

    An as-of carry: versions and rows are put in slot order inside (program,
    slot bucket), where each row takes the last version before it; rows that
    precede every version of their bucket take the last version of an earlier
    bucket, out of one summary row per (program, bucket). No row is multiplied,
    a program with a third of the rows is split across its buckets, and nothing
    runs while the plan is built.
    """
    version = F.struct(F.col("slot").alias("slot"), F.col("idl_hash").alias("idl_hash"))
    bucket = F.floor(F.col("slot") / bucket_slots).cast("bigint")
    payload = F.struct(*[F.col(c) for c in rows.columns])
    r = rows.select(F.col("program_id").alias("p"), bucket.alias("b"), F.col("slot").alias("s"), payload.alias("row"),
                    F.lit(None).cast(registry.select(version.alias("v")).schema["v"].dataType).alias("v"))
    v = registry.select(F.col("program_id").alias("p"), bucket.alias("b"), F.col("slot").alias("s"),
                        F.lit(None).cast(r.schema["row"].dataType).alias("row"), version.alias("v"))
    # versions stand before the rows of their slot
    inside = (Window.partitionBy("p", "b").orderBy("s", F.col("v").isNull(), F.col("v").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, 0))
    near = v.unionByName(r).withColumn("near", F.last("v", ignorenulls=True).over(inside)).where("row IS NOT NULL")
    per_bucket = v.groupBy("p", "b").agg(F.max("v").alias("v")).unionByName(
        rows.select(F.col("program_id").alias("p"), bucket.alias("b"), F.lit(None).cast(v.schema["v"].dataType).alias("v"))
        .distinct())
    per_bucket = per_bucket.groupBy("p", "b").agg(F.max("v").alias("v"))
    earlier = Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(F.col("p").alias("cp"), F.col("b").alias("cb"),
                                F.last("v", ignorenulls=True).over(earlier).alias("carried"))
    out = near.join(carried, F.col("p").eqNullSafe(F.col("cp")) & F.col("b").eqNullSafe(F.col("cb")), "left")
    valid = F.coalesce("near", "carried")
    return out.select("row.*", valid["slot"].alias("version_slot"), valid["idl_hash"].alias("idl_hash"))


def merged_idl(versions: list[tuple[int, Idl]]) -> tuple[Idl, list[tuple[int, Idl]]]:
    """One IDL whose instructions are those of all versions, named ``<version>/<name>``; and the versions by slot.

    A document that is registered again (same hash as the one before it) is no new version."""
    ordered = []
    for slot, idl in sorted(versions, key=lambda x: (x[0], x[1].hash)):
        if ordered and ordered[-1][1].hash == idl.hash:
            continue
        ordered.append((slot, idl))
    instructions, types = [], []
    for n, (_, idl) in enumerate(ordered):
        def scoped(fields, n=n):
            return tuple(replace(f, type=_scoped(f.type, f"{n}/")) for f in fields)

        instructions += [replace(ix, name=f"{n}/{ix.name}", args=scoped(ix.args)) for ix in idl.instructions]
        types += [replace(t, name=f"{n}/{t.name}", fields=scoped(t.fields),
                          variant_fields=tuple(map(scoped, t.variant_fields))) for t in idl.types]
    return replace(ordered[-1][1], instructions=tuple(instructions), types=tuple(types)), ordered


def _scoped(t, prefix: str):
    """An IDL type whose defined names carry a prefix."""
    if isinstance(t, str):
        return t
    if "defined" in t:
        return {"defined": prefix + defined_name(t)}
    if "array" in t:
        return {"array": [_scoped(t["array"][0], prefix), t["array"][1]]}
    return {k: _scoped(v, prefix) for k, v in t.items()}


def decode_as_of(tx: DataFrame, versions: list[tuple[int, Idl]], program_id: str, **options) -> DataFrame:
    """L-3: instruction rows of a program, each decoded with the IDL version valid at its slot.

    ``versions``: (slot, IDL) of one program, a few documents. Every version's
    definitions stand in one broadcast table, told apart by the version's
    number, which is an expression of the slot; definitions of equal layout
    share one decode, across versions too. Rows before the first version have
    none. Columns are those of ``ingest.decode_instructions`` (all that any
    version has) plus ``version_slot``.
    """
    from progscan.operators import ingest as I

    if not versions:
        raise ValueError("no versions")
    whole, ordered = merged_idl(versions)
    number = F.lit(None).cast("int")
    for n, (slot, _) in enumerate(ordered):
        number = F.when(F.col("slot") >= F.lit(slot), F.lit(n)).otherwise(number)
    pairs = [(f"{n}/{ix.name}", ix.discriminator, n) for n, (_, idl) in enumerate(ordered) for ix in idl.instructions]
    out = I.decode_instructions(tx, whole, program_id, version=number, pairs=pairs, **options)
    at = F.substring_index("ix_name", "/", 1).cast("int")
    slots = F.array(*[F.lit(slot).cast("bigint") for slot, _ in ordered])
    return out.withColumn("version_slot", F.get(slots, at)).withColumn(
        "ix_name", F.expr("substring(ix_name, instr(ix_name, '/') + 1)"))
