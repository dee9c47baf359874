"""Column functions over log entries."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def entry_bytes(key: str = "key", value: str = "value") -> Column:
    """The size of a length-prefixed entry: both lengths take two bytes."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 4


def row_checksum(key: str = "key", value: str = "value") -> Column:
    """CRC-32 of key and value with the key's length between them, so that they can't be taken for another split."""
    k, v = F.col(key).cast("binary"), F.coalesce(F.col(value).cast("binary"), F.lit(b""))
    return F.crc32(F.concat(k, F.lit(b":"), F.octet_length(k).cast("string").cast("binary"), F.lit(b":"), v))


def log_checksum() -> Column:
    """CRC-32 of a log row, all of its columns."""
    rest = F.concat_ws(":", F.lit(""), F.col("is_tombstone").cast("string"), F.col("seq").cast("string"), F.col("ord").cast("string"))
    return F.crc32(F.concat(row_checksum().cast("string").cast("binary"), rest.cast("binary")))


def frame(payload: bytes) -> bytes:
    """A record with its length and CRC-32 before it."""
    return struct.pack(">II", len(payload), zlib.crc32(payload)) + payload


def frames(data: bytes) -> list[bytes]:
    """The whole records of a log; a torn or damaged tail ends it."""
    out, at = [], 0
    while at + 8 <= len(data):
        n, crc = struct.unpack_from(">II", data, at)
        payload = data[at + 8 : at + 8 + n]
        if len(payload) < n or zlib.crc32(payload) != crc:
            break
        out.append(payload)
        at += 8 + n
    return out


def encode_entry(key: bytes, value: bytes | None) -> bytes:
    """Length-prefixed key and value; a delete has the length -1."""
    return struct.pack(">i", len(key)) + key + (struct.pack(">i", -1) if value is None else struct.pack(">i", len(value)) + value)


def decode_entries(data: bytes) -> list[tuple[bytes, bytes | None]]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from(">i", data, at)
        key, at = data[at + 4 : at + 4 + n], at + 4 + n
        (n,) = struct.unpack_from(">i", data, at)
        at += 4
        out.append((key, None if n < 0 else data[at : at + n]))
        at += max(n, 0)
    return out
