"""Base58 text -> bytes (Q-1), as an Arrow-batched pandas UDF.

Spark SQL has no base58 codec; the helper is a dozen lines of integer
arithmetic per value, run in batches on the executors. Invalid text -> NULL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Bitcoin base58 alphabet.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_INDEX = {c: i for i, c in enumerate(ALPHABET)}


def decode_py(text: str | None) -> bytes | None:
    if text is None:
        return None
    n = 0
    for ch in text:
        i = _INDEX.get(ch)
        if i is None:
            return None
        n = n * 58 + i
    body = n.to_bytes((n.bit_length() + 7) // 8, "big") if n else b""
    pad = len(text) - len(text.lstrip("1"))
    return b"\x00" * pad + body


def encode_py(data: bytes) -> str:
    n = int.from_bytes(data, "big")
    out = ""
    while n:
        n, r = divmod(n, 58)
        out = ALPHABET[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\x00"))) + out


def _b58(s: pd.Series) -> pd.Series:
    return s.map(decode_py)


def base58_decode(col: Column) -> Column:
    from pyspark.sql import types as T

    return F.pandas_udf(_b58, T.BinaryType())(col)


def _b58_encode(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else encode_py(bytes(b)))


def base58_encode(col: Column) -> Column:
    """Bytes -> base58 text (the form parsed-transaction RPC returns instruction data in)."""
    from pyspark.sql import types as T

    return F.pandas_udf(_b58_encode, T.StringType())(col)
