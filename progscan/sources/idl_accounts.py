"""A-12: IDL documents stored in program accounts.

Layout: 8-byte discriminator, 32-byte authority, u32 LE length at offset 40,
then the document (zlib-compressed JSON, or plain JSON in older programs).
Fewer than 44 bytes -> no document. Spark SQL has no inflate function, so
the bytes go through one Arrow-batched ``mapInArrow`` step; slicing the
length-prefixed body is done with expressions first.
"""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progscan.functions.binary import read_unsigned, slice_bytes

HEADER = 8 + 32
MIN_LEN = HEADER + 4


def _inflate(body: bytes | None) -> str | None:
    if body is None:
        return None
    try:
        text = zlib.decompress(body).decode("utf-8")
    except Exception:  # noqa: BLE001 - not compressed: older accounts hold plain JSON
        try:
            text = body.decode("utf-8")
        except UnicodeDecodeError:
            return None
    try:
        json.loads(text)
    except ValueError:
        return None
    return text


def extract_idl(accounts: DataFrame, keys: list[str] | None = None, data_col: str = "data") -> DataFrame:
    """``keys`` + ``idl_json`` for every account whose bytes hold a readable document."""
    keys = keys or ["program_id"]
    n = F.length(data_col)
    body = F.when(n >= MIN_LEN, slice_bytes(F.col(data_col), HEADER + 4, read_unsigned(F.col(data_col), HEADER, 4)))
    pre = accounts.select(*keys, body.alias("body"))
    key_fields = [f for f in pre.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", idl_json string"

    def inflate(batches):
        for b in batches:
            texts = pa.array([_inflate(x) for x in b.column("body").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [texts], names=keys + ["idl_json"])

    out = pre.mapInArrow(inflate, schema)
    return out.where(F.col("idl_json").isNotNull())
