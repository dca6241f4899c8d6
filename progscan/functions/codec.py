"""Hashes, names, cursors and the lenient base64 reader, as Spark Columns."""

from __future__ import annotations

import base64
import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
# Discriminator prefixes hashed with sha256 ahead of the item name.
DISC_PREFIX_INSTRUCTION = "global:"
DISC_PREFIX_EVENT = "event:"
DISC_PREFIX_ACCOUNT = "account:"
# Log line that carries an event payload.
EVENT_LOG_PREFIX = "Program data: "
# Names are lower-cased and every character outside this class becomes "_".
NAME_INVALID_CHARS = "[^a-z0-9_]"
# Column keys accepted in equality filters and aggregate fields.
SAFE_COLUMN_PATTERN = r"^[a-z_][a-z0-9_]*$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def discriminator_hex(prefix: str, name) -> Column:
    """First 8 bytes of sha256(prefix + name), as 16 lower-case hex digits."""
    return F.substring(F.sha2(F.concat(F.lit(prefix), _c(name)), 256), 1, 16)


def discriminator_py(prefix: str, name: str) -> str:
    """Driver-side twin of ``discriminator_hex`` (used to build literal tables)."""
    return hashlib.sha256((prefix + name).encode()).hexdigest()[:16]


def lenient_unbase64(text) -> Column:
    """Decode base64 that may be dirty without ever failing the task.

    Accepts the URL alphabet, drops every character outside the alphabet
    (padding included), and drops one dangling character that cannot form a
    byte. ``unbase64`` alone raises on a dangling character.
    """
    t = _c(text)
    c = F.regexp_replace(F.translate(t, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    n = F.length(c)
    keep = n - F.when(n % 4 == 1, F.lit(1)).otherwise(F.lit(0))
    # strict decode first (no regex on the common, clean path); coalesce is lazy
    return F.coalesce(F.try_to_binary(t, F.lit("base64")), F.unbase64(F.substring(c, F.lit(1), keep)))


def normalise_name(name) -> Column:
    return F.regexp_replace(F.lower(_c(name)), NAME_INVALID_CHARS, "_")


def normalise_name_py(name: str) -> str:
    return re.sub(NAME_INVALID_CHARS, "_", name.lower())


def table_name(prefix: str, program, item) -> Column:
    """``ix_/acc_/acc_history_`` + program + item, normalised."""
    return normalise_name(F.concat(F.lit(prefix + "_"), _c(program), F.lit("_"), _c(item)))


def table_name_py(prefix: str, program: str, item: str) -> str:
    return normalise_name_py(f"{prefix}_{program}_{item}")


def cursor_encode(slot, id_) -> Column:
    """base64url (no padding) of the JSON text ``{"slot":S,"id":I}``."""
    js = F.concat(F.lit('{"slot":'), _c(slot).cast("string"), F.lit(',"id":'),
                  _c(id_).cast("string"), F.lit("}"))
    return F.regexp_replace(F.translate(F.base64(F.encode(js, "UTF-8")), "+/", "-_"), "=+$", "")


def cursor_encode_py(slot: int, id_: int, signature: str | None = None) -> str:
    """Cursor text; a signature is only added where the next row has the same (slot, id)."""
    at = {"slot": slot, "id": id_} | ({} if signature is None else {"sig": signature})
    raw = json.dumps(at, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def cursor_decode_py(cursor: str | None):
    """Cursor text -> (slot, id), or None when it cannot be read (first page)."""
    if not cursor:
        return None
    try:
        pad = "=" * (-len(cursor) % 4)
        obj = json.loads(base64.urlsafe_b64decode(cursor + pad))
        return int(obj["slot"]), int(obj["id"])
    except Exception:
        return None


def cursor_signature_py(cursor: str | None) -> str | None:
    """The signature a cursor carries, if any."""
    if cursor_decode_py(cursor) is None:
        return None
    return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))).get("sig")


def idl_hash_hex(json_text) -> Column:
    """Document hash: first 16 hex digits of sha256 over the JSON text."""
    return F.substring(F.sha2(_c(json_text), 256), 1, 16)


def idl_hash_py(doc: dict) -> str:
    return hashlib.sha256(canonical_json(doc).encode()).hexdigest()[:16]


def canonical_json(doc) -> str:
    """JSON text with the key order of the document and no spaces."""
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)
