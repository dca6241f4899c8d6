"""Plain-Python Borsh encoders used to build test payloads."""

import base64
import hashlib
import struct


def disc(prefix: str, name: str) -> bytes:
    return hashlib.sha256((prefix + name).encode()).digest()[:8]


def u8(v):
    return struct.pack("<B", v)


def u16(v):
    return struct.pack("<H", v)


def u32(v):
    return struct.pack("<I", v)


def u64(v):
    return struct.pack("<Q", v)


def i64(v):
    return struct.pack("<q", v)


def string(s: str) -> bytes:
    b = s.encode()
    return u32(len(b)) + b


def b64(b: bytes) -> str:
    return base64.b64encode(b).decode()
