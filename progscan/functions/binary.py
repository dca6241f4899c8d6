"""Little-endian byte helpers expressed as Spark Columns.

Spark SQL has no bit-cast or byte-swap on BINARY, and ``reverse`` on binary
goes through a string cast that corrupts bytes. So the helpers take a small
slice with ``substring`` (which works on BINARY), ``hex`` it, and swap the
two-character groups of that short hex string. Every piece stays a built-in
expression inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def swap_hex(h: Column, nbytes: int) -> Column:
    """Reverse the byte order of a hex string holding ``nbytes`` bytes.

    Missing bytes (a shorter string) come out as empty pieces, so a short input
    yields the reversed hex of what is there.
    """
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(nbytes))])


def slice_bytes(raw: Column, offset, nbytes) -> Column:
    """``raw[offset : offset + nbytes]`` (0-based offset, may be a Column)."""
    return _c(raw).substr(_c(offset) + 1, _c(nbytes))


def le_hex_of(raw: Column, offset, nbytes: int) -> Column:
    """Big-endian hex of the little-endian integer stored at ``offset``."""
    return swap_hex(F.hex(slice_bytes(raw, offset, nbytes)), nbytes)


def read_unsigned(raw: Column, offset, nbytes: int) -> Column:
    """Unsigned LE integer of 1..4 bytes as BIGINT (no bounds check)."""
    return F.conv(le_hex_of(raw, offset, nbytes), 16, 10).cast("bigint")


def read_signed(raw: Column, offset, nbytes: int) -> Column:
    """Two's complement LE integer of 1..4 bytes as BIGINT (no bounds check)."""
    u = read_unsigned(raw, offset, nbytes)
    half = 1 << (8 * nbytes - 1)
    return F.when(u >= F.lit(half), u - F.lit(2 * half)).otherwise(u)


def read_u64_text(raw: Column, offset) -> Column:
    """Unsigned 64-bit LE as a decimal string; ``conv`` keeps the full 2^64-1 range."""
    return F.conv(le_hex_of(raw, offset, 8), 16, 10)


def read_i64_text(raw: Column, offset) -> Column:
    """Signed 64-bit LE as a decimal string (``conv`` to a negative base is signed)."""
    return F.conv(le_hex_of(raw, offset, 8), 16, -10)


def read_float(raw: Column, offset, nbytes: int) -> Column:
    """IEEE-754 LE float (4 bytes) or double (8 bytes) as DOUBLE.

    There is no bit-cast in Spark SQL, so the value is assembled from sign,
    exponent and mantissa; every step is exact in double arithmetic.
    """
    if nbytes == 8:
        ebits, mbits = 11, 52
    elif nbytes == 4:
        ebits, mbits = 8, 23
    else:  # pragma: no cover - guarded by callers
        raise ValueError(nbytes)
    bias = (1 << (ebits - 1)) - 1
    h = le_hex_of(raw, offset, nbytes)
    # conv to a negative base reads the 64-bit pattern as signed; keep it unsigned
    # by splitting the top nibble off for the 8-byte case.
    if nbytes == 8:
        top = F.conv(F.substring(h, 1, 1), 16, 10).cast("bigint")
        rest = F.conv(F.substring(h, 2, 15), 16, 10).cast("bigint")
        sign = F.shiftright(top, 3)
        expo = F.shiftleft(top.bitwiseAND(F.lit(7)), 8) + F.shiftright(rest, 52)
        mant = rest.bitwiseAND(F.lit((1 << 52) - 1))
    else:
        bits = F.conv(h, 16, 10).cast("bigint")
        sign = F.shiftright(bits, 31)
        expo = F.shiftright(bits, mbits).bitwiseAND(F.lit((1 << ebits) - 1))
        mant = bits.bitwiseAND(F.lit((1 << mbits) - 1))
    frac = mant.cast("double") / F.lit(float(1 << mbits))
    sgn = F.when(sign == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    emax = (1 << ebits) - 1
    normal = (F.lit(1.0) + frac) * F.pow(F.lit(2.0), (expo - F.lit(bias)).cast("double"))
    subnormal = frac * F.pow(F.lit(2.0), F.lit(float(1 - bias)))
    special = F.when(mant == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    mag = (F.when(expo == emax, special)
           .when(expo == 0, subnormal)
           .otherwise(normal))
    return sgn * mag


# ---------------------------------------------------------------- encoding --

def le_hex(value: Column, nbytes: int) -> Column:
    """Little-endian hex of an integer Column in ``nbytes`` bytes (two's complement)."""
    v, low = _c(value).cast("bigint"), F.lit(0x0F0F0F0F0F0F0F0F)
    # the two digits of every byte change places, so that the reversed text holds the bytes in reverse
    v = F.shiftleft(v.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(v, 4).bitwiseAND(low))
    h = F.reverse(F.lpad(F.hex(v), 16, "0"))
    return h if nbytes == 8 else F.substring(h, 1, 2 * nbytes)


def le_payload(*hex_parts: Column) -> Column:
    """Concatenate hex pieces into BINARY."""
    return F.unhex(F.concat(*hex_parts))


def utf8_len_prefixed_hex(text: Column) -> Column:
    """Borsh string: u32 LE byte length + UTF-8 bytes, as hex."""
    b = F.encode(text, "UTF-8")
    return F.concat(le_hex(F.length(b), 4), F.hex(b))
