"""Compile an IDL field list into Spark Column expressions.

Decoding rules (little-endian, offsets in bytes):

* every field first checks ``len <= offset`` and then yields NULL without
  moving the offset;
* a fixed-width read that runs past the end fails: the field is NULL and the
  next field is read at the *same* offset;
* ``u128``/``i128``/``publicKey`` never fail, a short tail gives a shorter
  value and the offset still moves by the full width;
* strings and vectors whose length prefix overruns yield NULL and keep the
  offset;
* ``defined`` types yield NULL and consume nothing (``stored`` mode).

Each field becomes a few staged columns (value, next offset) so the
expression tree stays linear in the number of fields; Catalyst does not
collapse the stages because the offsets are referenced more than once.
Layouts that need a per-element loop over variable-width items (vectors of
strings, nested vectors, options inside vectors, structs without a fixed width)
go through one Arrow-batched pandas UDF instead (``plans.readers``).

With a type registry (``typed`` mode) the rules are plain Borsh: ``defined``
types are read by their definition, every byte of a value must be there, and
after a field that fails nothing more is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from progscan.functions import binary as B
from progscan.plans.idl import Field, IdlType, defined_name
from progscan.plans.readers import LEAVES, WRITTEN_OUT, decode_in_batches

FIXED_WIDTH = {name: leaf.width for name, leaf in LEAVES.items()}
# Fixed-width types whose short read yields a shorter value instead of failing.
NEVER_FAILS = {"bool"} | {name for name, leaf in LEAVES.items() if leaf.cut}


@dataclass
class Piece:
    text: Column     # stored text value (NULL when absent)
    js: Column       # JSON fragment of the value as it appears inside arrays/objects
    end: Column      # offset after the field when it succeeds
    threw: Column    # the read failed: value NULL, offset unchanged


def _false() -> Column:
    return F.lit(False)


def _null_s() -> Column:
    return F.lit(None).cast("string")


# Control characters whose \\u escape holds a hex letter; Spark writes it upper-case, JavaScript lower-case.
_LETTERED = [f"{c:04X}" for c in range(32) if c not in (8, 9, 10, 12, 13) and f"{c:X}" != f"{c:x}"]


def _quote(s: Column) -> Column:
    """JSON string literal of ``s`` (NULL -> ``null``)."""
    q = F.to_json(F.struct(s.alias("v")))  # {"v":"..."}
    q = q.substr(F.lit(6), F.length(q) - 6)
    lower = q
    for code in _LETTERED:
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    marked = s.rlike("[\\x0B\\x0E\\x0F\\x1A-\\x1F]")
    return F.when(s.isNull(), F.lit("null")).when(marked, lower).otherwise(q)


def number_text(v: Column) -> Column:
    """Text of a double as ECMAScript prints it: plain from 1e-6 up to 1e21, else with an exponent.

    Spark's own text (Java 17) has a digit or two too many at times: as long as
    one digit less reads back as the same double, that is taken.
    """
    def digits(text: Column) -> Column:
        mantissa, power = F.substring_index(text, "E", 1), F.lit(0)
        power = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(power)
        whole = F.substring_index(mantissa, ".", 1)
        every = F.concat(whole, F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise(""))
        kept = F.regexp_replace(every, "^0+", "")
        return F.struct(F.regexp_replace(kept, "0+$", "").alias("d"),
                        (F.length(whole) + power - (F.length(every) - F.length(kept))).cast("int").alias("at"))

    def shortest(x: Column, own: Column) -> Column:
        def better(p: Column) -> Column:
            less = F.printf(F.concat(F.lit("%."), F.length(p["d"]) - 2, F.lit("E")), F.abs(x))
            return F.when(F.length(p["d"]) < 2, p).otherwise(
                B.let(less, lambda t: F.when(t.cast("double") == F.abs(x), digits(t)).otherwise(p)))

        return F.aggregate(F.array(*[F.lit(i) for i in range(3)]), digits(own), lambda p, _: better(p))

    def laid_out(p: Column) -> Column:
        d, at, n = p["d"], p["at"], F.length(p["d"])
        power = at - 1
        scientific = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), d.substr(F.lit(2), n))).otherwise(""),
                              F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(power).cast("string"))
        return (F.when((n <= at) & (at <= 21), F.concat(d, F.repeat(F.lit("0"), at - n)))
                .when((at > 0) & (at <= 21), F.concat(d.substr(F.lit(1), at), F.lit("."), d.substr(at + 1, n)))
                .when((at > -6) & (at <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), d))
                .otherwise(scientific))

    def text_of(x: Column) -> Column:
        return (F.when(F.isnan(x), F.lit("NaN"))
                .when(x == F.lit(float("inf")), F.lit("Infinity"))
                .when(x == F.lit(float("-inf")), F.lit("-Infinity"))
                .when(x == 0, F.lit("0"))
                .otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
                                    B.let(shortest(x, F.abs(x).cast("string")), laid_out))))

    return B.let(v, lambda x: F.when(x.isNotNull(), text_of(x)))


def _enum_def(t: IdlType, registry):
    """The registry's enum without fields that a ``defined`` type names, else None."""
    if registry is None or not (isinstance(t, dict) and "defined" in t):
        return None
    td = registry(defined_name(t))
    return td if td is not None and td.kind == "enum" and not any(td.variant_fields) else None


def _fixed_item(t: IdlType, registry) -> bool:
    if isinstance(t, str):
        return t in FIXED_WIDTH
    return "defined" in t and (registry is None or fixed_width(t, registry) is not None)


def is_native(t: IdlType, registry=None) -> bool:
    """True when ``t`` compiles to built-in expressions."""
    if isinstance(t, str):
        return True  # unknown names decode to NULL and consume nothing
    if "option" in t:
        return is_native(t["option"], registry)
    if "defined" in t:
        return _fixed_item(t, registry) or _enum_def(t, registry) is not None
    if "vec" in t:
        return _fixed_item(t["vec"], registry)
    if "array" in t:
        return _fixed_item(t["array"][0], registry) or registry is not None and fixed_width(t, registry) is not None
    return True


def _guard(n: Column, o: Column, p: Piece) -> Piece:
    """Apply the ``len <= offset`` rule in front of a decoded piece."""
    g = n <= o
    return Piece(
        text=F.when(g, _null_s()).otherwise(p.text),
        js=F.when(g, F.lit("null")).otherwise(p.js),
        end=F.when(g, o).otherwise(p.end),
        threw=F.when(g, _false()).otherwise(p.threw),
    )


def _scalar(t: str, raw: Column, n: Column, o: Column, strict: bool = False) -> Piece:
    """Decode a scalar at ``o`` assuming ``n > o`` (the guard is applied by the caller)."""
    w = FIXED_WIDTH.get(t)
    cut = n < o + w if strict and t in NEVER_FAILS else _false()
    if t == "bool":
        v = F.when(B.slice_bytes(raw, o, 1) != F.lit(bytearray(b"\x00")), F.lit("true")).otherwise(F.lit("false"))
        return Piece(v, v, o + 1, _false())
    if t in ("u8", "u16", "u32"):
        v = B.read_unsigned(raw, o, w).cast("string")
        return Piece(v, v, o + w, n < o + w)
    if t in ("i8", "i16", "i32"):
        v = B.read_signed(raw, o, w).cast("string")
        return Piece(v, v, o + w, n < o + w)
    if t == "u64":
        v = B.read_u64_text(raw, o)
        return Piece(v, F.concat(F.lit('"'), v, F.lit('"')), o + 8, n < o + 8)
    if t == "i64":
        v = B.read_i64_text(raw, o)
        return Piece(v, F.concat(F.lit('"'), v, F.lit('"')), o + 8, n < o + 8)
    if t in ("u128", "i128"):
        v = F.concat(F.lit("0x"), F.lower(B.le_hex_of(raw, o, 16)))
        return Piece(v, F.concat(F.lit('"'), v, F.lit('"')), o + 16, cut)
    if t in ("f32", "f64"):
        v = number_text(B.read_float(raw, o, w))
        return Piece(v, B.let(v, lambda x: F.when(x.isin("NaN", "Infinity", "-Infinity"), F.lit("null")).otherwise(x)),
                     o + w, n < o + w)
    if t == "publicKey":
        v = F.base64(B.slice_bytes(raw, o, 32))
        return Piece(v, F.concat(F.lit('"'), v, F.lit('"')), o + 32, cut)
    if t == "string":
        ln = B.read_unsigned(raw, o, 4)
        ok = (n >= o + 4) & (n >= o + 4 + ln)
        s = F.make_valid_utf8(B.slice_bytes(raw, o + 4, ln).cast("string"))
        v = F.when(ok, s)
        return Piece(v, F.when(ok, _quote(s)).otherwise(F.lit("null")),
                     F.when(ok, o + 4 + ln).otherwise(o), ~ok if strict else _false())
    # unknown scalar names: NULL, nothing consumed
    return Piece(_null_s(), F.lit("null"), o, _false())


def _fixed_elem_js(t: str, raw: Column, n: Column, cur: Column) -> Column:
    return _scalar(t, raw, n, cur).js


def _list_text(count: Column, item) -> Column:
    """``[item(0),item(1),...]`` of ``count`` items (``sequence`` has no empty form)."""
    items = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(count, F.lit(1)) - 1), item)
    return F.when(count > 0, F.concat(F.lit("["), F.array_join(F.slice(items, 1, count.cast("int")), ",", "null"),
                                      F.lit("]"))).otherwise(F.lit("[]"))


def _vec(elem: IdlType, raw: Column, n: Column, o: Column, registry=None) -> Piece:
    start, short = o + 4, n < o + 4
    cnt = B.read_unsigned(raw, o, 4)
    if registry is not None:
        # typed mode: all ``cnt`` items must be present; items without bytes are counted beyond WRITTEN_OUT
        w = fixed_width(elem, registry)
        ok = ~short & (n >= start + cnt * w)
        body = _list_text(F.when(ok, cnt) if w else F.least(cnt, F.lit(WRITTEN_OUT + 1)),
                          lambda i: _strict_js(elem, raw, n, start + i * w, registry))
        if not w:
            body = F.when(cnt - 1 > WRITTEN_OUT, F.concat(F.lit('{"item":'), _strict_js(elem, raw, n, start, registry),
                                                          F.lit(',"count":'), cnt.cast("string"), F.lit("}"))).otherwise(body)
        text = F.when(ok, body)
        return Piece(text, F.when(ok, body).otherwise(F.lit("null")), F.when(ok, start + cnt * w).otherwise(o), ~ok)
    if isinstance(elem, dict):
        # items of a defined type: read while the cursor is inside the data; it never moves
        k = F.when(n > start, cnt).otherwise(F.lit(0))
        body = (F.when(k - 1 > WRITTEN_OUT, F.concat(F.lit('{"item":null,"count":'), k.cast("string"), F.lit("}")))
                .when(k > 0, F.concat(F.lit("["), F.repeat(F.lit("null,"), (k - 1).cast("int")), F.lit("null]")))
                .otherwise(F.lit("[]")))
        text = F.when(short, _null_s()).otherwise(body)
        return Piece(text, F.when(short, F.lit("null")).otherwise(_quote(body)),
                     F.when(short, o).otherwise(start), _false())
    w = FIXED_WIDTH[elem]
    avail = n - start
    k = F.least(cnt, F.greatest(F.ceil(avail / F.lit(w)).cast("bigint"), F.lit(0)))
    partial = (k * w > avail) if elem not in NEVER_FAILS else _false()
    body = _list_text(k, lambda i: _fixed_elem_js(elem, raw, n, start + i * w))
    ok = ~short & ~partial
    text = F.when(ok, body)
    return Piece(text, F.when(ok, _quote(body)).otherwise(F.lit("null")),
                 F.when(ok, start + k * w).otherwise(o), F.when(short, _false()).otherwise(partial))


def _array(elem: IdlType, count: int, raw: Column, n: Column, o: Column, registry=None) -> Piece:
    size = F.lit(count).cast("bigint")
    if registry is not None:
        w = fixed_width(elem, registry)
        ok = n >= o + count * w
        body = _list_text(size, lambda i: _strict_js(elem, raw, n, o + i * w, registry))
        return Piece(F.when(ok, body), F.when(ok, body).otherwise(F.lit("null")),
                     F.when(ok, o + count * w).otherwise(o), ~ok)
    if isinstance(elem, dict):
        body = F.lit("[" + ",".join(["null"] * count) + "]")
        return Piece(body, _quote(body), o, _false())
    w = FIXED_WIDTH[elem]
    avail = n - o
    if elem in NEVER_FAILS:
        k = F.least(size, F.ceil(avail / F.lit(w)).cast("bigint"))
        threw = _false()
    else:
        full = F.floor(avail / F.lit(w)).cast("bigint")
        k = F.least(size, full)
        threw = (full < size) & (avail % F.lit(w) != 0)
    body = _list_text(size, lambda i: F.when(i < k, _fixed_elem_js(elem, raw, n, o + i * w)).otherwise(F.lit("null")))
    text = F.when(threw, _null_s()).otherwise(body)
    return Piece(text, F.when(threw, F.lit("null")).otherwise(_quote(body)), o + k * w, threw)


def _struct_def(t: IdlType, registry):
    """The registry struct of a ``defined`` type in typed mode, else None."""
    if registry is None or not (isinstance(t, dict) and "defined" in t):
        return None
    td = registry(defined_name(t))
    return td if td is not None and td.kind == "struct" else None


def fixed_width(t: IdlType, registry=None) -> int | None:
    """Byte width of a fixed-layout type (scalars, arrays, registry structs), else None."""
    if isinstance(t, str):
        return FIXED_WIDTH.get(t)
    if "array" in t:
        w = fixed_width(t["array"][0], registry)
        return None if w is None else w * int(t["array"][1])
    if "defined" in t and registry is not None:
        td = _struct_def(t, registry)
        if td is None:
            return None
        ws = [fixed_width(f.type, registry) for f in td.fields]
        return None if any(w is None for w in ws) else sum(ws)
    return None


def _strict_js(t: IdlType, raw: Column, n: Column, cur: Column, registry) -> Column:
    """JSON of a fixed-width value whose bytes are known to be present."""
    if isinstance(t, str):
        return _scalar(t, raw, n, cur).js
    if "array" in t:
        elem, count = t["array"]
        w = fixed_width(elem, registry)
        return F.concat(F.lit("["), F.concat_ws(",", *[_strict_js(elem, raw, n, cur + i * w, registry)
                                                        for i in range(int(count))]), F.lit("]"))
    return _struct_js(_struct_def(t, registry), raw, n, cur, registry)


def _struct_js(td, raw: Column, n: Column, o: Column, registry) -> Column:
    import json as _json

    parts, off = [], 0
    for f in td.fields:
        parts.append(F.concat(F.lit(_json.dumps(f.name) + ":"), _strict_js(f.type, raw, n, o + off, registry)))
        off += fixed_width(f.type, registry)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def field_piece(t: IdlType, raw: Column, n: Column, o: Column, registry=None) -> Piece:
    """Decode one field of type ``t`` at offset ``o`` (guard included).

    ``registry`` (name -> type definition) switches to typed mode: fixed-width
    structs and enums without fields are decoded, as JSON objects and as their
    variant's name, instead of the stored mode's NULL that consumes nothing;
    every value is read strictly (all bytes present).
    """
    strict = registry is not None
    if isinstance(t, str):
        return _guard(n, o, _scalar(t, raw, n, o, strict))
    if "option" in t:
        inner = field_piece(t["option"], raw, n, o + 1, registry)
        none = B.slice_bytes(raw, o, 1) == F.lit(bytearray(b"\x00"))
        p = Piece(
            text=F.when(none, _null_s()).otherwise(inner.text),
            js=F.when(none, F.lit("null")).otherwise(inner.js),
            end=F.when(none, o + 1).otherwise(inner.end),
            threw=F.when(none, _false()).otherwise(inner.threw),
        )
        return _guard(n, o, p)
    if "defined" in t:
        edef, sdef = _enum_def(t, registry), _struct_def(t, registry)
        if edef is not None:
            names = F.array(*[F.lit(v) for v in edef.variants])
            v = F.get(names, B.read_unsigned(raw, o, 1).cast("int"))
            return _guard(n, o, Piece(v, F.coalesce(_quote(v), F.lit("null")), o + 1, v.isNull()))
        if sdef is None:
            return Piece(_null_s(), F.lit("null"), o, _false())
        w = fixed_width(t, registry)
        ok = n >= o + w
        js = _struct_js(sdef, raw, n, o, registry)
        return _guard(n, o, Piece(F.when(ok, js), F.when(ok, js).otherwise(F.lit("null")),
                                  F.when(ok, o + w).otherwise(o), ~ok))
    if "vec" in t:
        return _guard(n, o, _vec(t["vec"], raw, n, o, registry))
    if "array" in t:
        elem, count = t["array"]
        return _guard(n, o, _array(elem, int(count), raw, n, o, registry))
    return Piece(_null_s(), F.lit("null"), o, _false())


#: Fixed-width types whose short read fails and keeps the offset, so that a payload's length tells where each is read.
PLACED = ("u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64")


def is_placed(fields) -> bool:
    """Whether the place of every field follows from the payload's length alone (stored mode)."""
    return 0 < len(fields) <= MAX_PLACED and all(isinstance(f.type, str) and f.type in PLACED for f in fields)


#: With more fields there are too many lengths of short payloads to tell apart.
MAX_PLACED = 8


def _places(widths: list[int], start: int) -> list[list[tuple[int, int]]]:
    """Per field, (length, offset) steps from the longest payload down: from that length on (and below the step before)
    it is read at the offset, or not at all at offset -1."""
    steps = [[] for _ in widths]
    for n in range(start + sum(widths), -1, -1):
        at = start
        for mine, w in zip(steps, widths):
            here = at if n >= at + w else -1
            at += w if here >= 0 else 0
            if mine and mine[-1][1] == here:
                mine[-1] = (n, here)
            else:
                mine.append((n, here))
    return steps


def _placed_values(raw: Column, fields, start: int) -> list[Piece]:
    """The fields of ``is_placed`` as expressions of the payload only, which Catalyst keeps in one projection."""
    n, out = F.length(raw), []
    for f, steps in zip(fields, _places([FIXED_WIDTH[f.type] for f in fields], start)):
        text = js = None
        for least, at in steps[:-1] if steps[-1][1] < 0 else steps:
            p = _scalar(f.type, raw, n, F.lit(at)) if at >= 0 else Piece(_null_s(), F.lit("null"), F.lit(0), _false())
            cond = n >= F.lit(least)
            text = F.when(cond, p.text) if text is None else text.when(cond, p.text)
            js = F.when(cond, p.js) if js is None else js.when(cond, p.js)
        out.append(Piece(text, js.otherwise(F.lit("null")), F.lit(0), _false()))
    return out


def decode_fields(df: DataFrame, raw_col: str, fields: list[Field] | tuple[Field, ...],
                  out_names: list[str], start: int = 8, js_col: str | None = None,
                  registry=None, js_values: list[str] | None = None) -> DataFrame:
    """Add one stored-text column per field, decoded from BINARY ``raw_col``.

    ``js_col`` optionally adds the JSON object text of all fields in order
    (the event payload form); ``js_values`` instead keeps each field's JSON
    fragment in the named columns, for callers that assemble objects
    themselves. Temporary offset columns are dropped.
    """
    fields = list(fields)
    jnames = js_values or ([f"__fj{i}" for i in range(len(fields))] if js_col else None)
    if not all(is_native(f.type, registry) for f in fields):
        df = decode_in_batches(df, raw_col, fields, out_names, start, jnames, registry)
        if js_col:
            df = df.withColumn(js_col, F.when(F.col(raw_col).isNotNull(), json_object([f.name for f in fields], jnames)))
        return df.drop(*jnames) if js_col and not js_values else df
    raw = F.col(raw_col)
    if registry is None and is_placed(fields):
        pieces = _placed_values(raw, fields, start)
        df = df.withColumns({name: p.text for name, p in zip(out_names, pieces)}
                            | {j: p.js for j, p in zip(jnames or [], pieces)})
        if js_col:
            df = df.withColumn(js_col, json_object([f.name for f in fields], jnames))
        return df.drop(*jnames) if js_col and not js_values else df
    n = F.length(raw).cast("bigint")
    off = "__off"
    df = df.withColumn(off, F.lit(start).cast("bigint"))
    for i, (f, name) in enumerate(zip(fields, out_names)):
        p = field_piece(f.type, raw, n, F.col(off), registry)
        # value first (it reads the old offset), then move the offset
        df = df.withColumn(name, F.when(p.threw, _null_s()).otherwise(p.text))
        if jnames:
            df = df.withColumn(jnames[i], F.when(p.threw, F.lit("null")).otherwise(p.js))
        # typed mode reads nothing after a field that fails
        df = df.withColumn(off, F.when(p.threw, F.col(off) if registry is None else n).otherwise(p.end).cast("bigint"))
    if js_col:
        df = df.withColumn(js_col, json_object([f.name for f in fields], jnames))
        if not js_values:
            df = df.drop(*jnames)
    return df.drop(off)


def json_object(keys: list[str], value_cols: list[str]) -> Column:
    """``{"k1":v1,...}`` from columns that hold JSON fragments."""
    parts = [F.concat(F.lit(_json_key(k) + ":"), F.col(c)) for k, c in zip(keys, value_cols)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _json_key(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


# ----------------------------------------------------------- typed mode ---

def spark_type(t: IdlType, types_registry=None) -> T.DataType:
    """Spark type of an IDL type in ``typed`` mode."""
    simple = {
        "bool": T.BooleanType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(),
        "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
        "u64": T.DecimalType(20, 0), "u128": T.StringType(), "i128": T.StringType(),
        "f32": T.FloatType(), "f64": T.DoubleType(), "string": T.StringType(), "publicKey": T.StringType(),
    }
    if isinstance(t, str):
        if t not in simple:
            raise ValueError(f"unsupported IDL type {t!r}")
        return simple[t]
    if "option" in t:
        return spark_type(t["option"], types_registry)
    if "vec" in t:
        return T.ArrayType(spark_type(t["vec"], types_registry))
    if "array" in t:
        return T.ArrayType(spark_type(t["array"][0], types_registry))
    if "defined" in t:
        td = types_registry(defined_name(t)) if types_registry else None
        if td is None or td.kind != "struct":
            return T.StringType()
        return T.StructType([T.StructField(f.name, spark_type(f.type, types_registry)) for f in td.fields])
    raise ValueError(f"unsupported IDL type {t!r}")


def typed_column(stored: Column, t: IdlType, registry=None) -> Column:
    """Convert a stored-text value to its typed Spark value (``try_cast``: dirty text -> NULL)."""
    st = spark_type(t, registry)
    if isinstance(st, (T.ArrayType, T.StructType)):
        return F.from_json(stored, st)
    if isinstance(st, T.BooleanType):
        return stored == F.lit("true")
    return stored.try_cast(st)


def instruction_table_schema(idl, ix_name: str, mode: str = "stored") -> T.StructType:
    """I-1 as a Spark schema: the columns of ``ix_<program>_<instruction>``.

    ``stored`` keeps the reference's text storage for arguments; ``typed`` uses
    the Spark type of each IDL type."""
    from progscan.plans.idl import column_name

    ix = idl.instruction(ix_name)
    fields = [T.StructField("id", T.LongType(), False), T.StructField("signature", T.StringType(), False),
              T.StructField("slot", T.LongType(), False), T.StructField("block_time", T.LongType()),
              T.StructField("cpi_depth", T.IntegerType(), False), T.StructField("parent_ix_index", T.IntegerType())]
    fields += [T.StructField(column_name("account_", a.name), T.StringType()) for a in ix.accounts]
    for f in ix.args:
        t = spark_type(f.type, idl.type_def) if mode == "typed" else T.StringType()
        fields.append(T.StructField(column_name("arg_", f.name), t))
    return T.StructType(fields)
