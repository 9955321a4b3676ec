"""Hashes and byte helpers whose values are part of a format."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The FNV-1a offset and prime for 64 bits, and the reflected Castagnoli polynomial.
_FNV_OFFSET, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_CASTAGNOLI = 0x82F63B78
_M64 = (1 << 64) - 1


def fnv1a_64(data: str | bytes) -> int:
    """FNV-1a over UTF-8 bytes: a table's identity is that of its name."""
    h = _FNV_OFFSET
    for b in data.encode() if isinstance(data, str) else data:
        h = (h ^ b) * _FNV_PRIME & _M64
    return h


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (_CASTAGNOLI if i & 1 else 0)
        table.append(i)
    return table


_CRC = _crc_table()


def crc32c(data: bytes, seed: int = 0) -> int:
    """CRC-32C (Castagnoli); ``seed`` continues an earlier sum."""
    c = seed ^ 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def siphash_2_4(data: bytes, k0: int, k1: int) -> int:
    """SipHash-2-4, 64 bits."""
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def rounds(n: int) -> None:
        rotate = lambda x, s: (x << s | x >> (64 - s)) & _M64
        for _ in range(n):
            for a, b, s in ((0, 1, 13), (2, 3, 16)):
                v[a] = (v[a] + v[b]) & _M64
                v[b] = rotate(v[b], s) ^ v[a]
            v[0] = rotate(v[0], 32)
            for a, b, s in ((2, 1, 17), (0, 3, 21)):
                v[a] = (v[a] + v[b]) & _M64
                v[b] = rotate(v[b], s) ^ v[a]
            v[2] = rotate(v[2], 32)

    padded = data + bytes(7 - len(data) % 8) + bytes([len(data) & 0xFF])
    for i in range(0, len(padded), 8):
        word = int.from_bytes(padded[i : i + 8], "little")
        v[3] ^= word
        rounds(2)
        v[0] ^= word
    v[2] ^= 0xFF
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def be64(value: int) -> bytes:
    return value.to_bytes(8, "big")


def from_be64(data: bytes) -> int:
    return int.from_bytes(data[:8], "big")


def next_prefix(data: bytes) -> bytes:
    """The big-endian number after an eight-byte prefix: the end of the range of all keys with it."""
    return be64((from_be64(data) + 1) & _M64)


def mini_key(key: Column) -> Column:
    """The first eight bytes of a binary key."""
    return F.substring(key, 1, 8)


def ranges_overlap(first: Column, last: Column, start: bytes | None, end: bytes | None) -> Column:
    """Whether a file's keys [first, last] meet [start, end); None is unbounded."""
    ok = F.lit(True)
    if start:
        ok = ok & (last >= F.lit(start))
    if end:
        ok = ok & (first < F.lit(end))
    return ok


_ESCAPE = re.compile(rb"%([0-9A-Fa-f])(.)|\+", re.S)


def percent_decoded(text: str | None) -> str | None:
    """Percent signs and plus signs of a URL query decoded; a percent sign without a hexadecimal digit and a further byte after it stays.

    Of two bytes of which only the first is a digit, that digit is the value. What is no UTF-8 then is replaced.
    """
    if text is None:
        return None

    def byte(m: re.Match) -> bytes:
        if not m[1]:
            return b" "
        return bytes([int(m[1] + m[2] if m[2] in b"0123456789abcdefABCDEF" else m[1], 16)])

    return _ESCAPE.sub(byte, text.encode()).decode(errors="replace")


def percent_decode(text: Column) -> Column:
    """``percent_decoded`` of each row, by Arrow batches."""
    return _each(percent_decoded, "string")(text)


def _each(f: Callable, kind: str) -> Callable[[Column], Column]:
    """A column function that applies ``f`` to the values of Arrow batches; null stays null."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], {"string": pa.string(), "long": pa.int64()}[kind])

    return F.arrow_udf(run, kind)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fnv1a_64_of(data: Column) -> Column:
    """``fnv1a_64`` of each binary value, as a signed long."""
    return _each(lambda b: _signed(fnv1a_64(b)), "long")(data)


def crc32c_of(data: Column) -> Column:
    """``crc32c`` of each binary value."""
    return _each(lambda b: crc32c(b), "long")(data)


def siphash_2_4_of(data: Column, k0: int, k1: int) -> Column:
    """``siphash_2_4`` of each binary value, as a signed long."""
    return _each(lambda b: _signed(siphash_2_4(b, k0, k1)), "long")(data)


def be64_of(value: Column) -> Column:
    """The eight big-endian bytes of a long (two's complement)."""
    return F.to_binary(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit("hex"))


def be64_value(data: Column) -> Column:
    """The long of eight big-endian bytes."""
    unsigned = F.conv(F.hex(F.substring(data, 1, 8)), 16, 10).cast("decimal(20,0)")
    return F.when(unsigned >= F.lit(str(1 << 63)).cast("decimal(20,0)"), unsigned - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(unsigned).cast("long")
