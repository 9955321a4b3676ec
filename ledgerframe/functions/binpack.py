"""The binary row codec: big-endian numbers, length-prefixed strings, tagged nullables, fields in declaration order."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_FORMATS = {T.ByteType: ">b", T.ShortType: ">h", T.IntegerType: ">i", T.LongType: ">q", T.FloatType: ">f", T.DoubleType: ">d"}


def _optional(nullable: bool, value: object, body) -> bytes:
    if not nullable:
        if value is None:
            raise ValueError("null in a field that is not nullable")
        return body()
    return b"\0" if value is None else b"\1" + body()


def encode(value: object, kind: T.DataType) -> bytes:
    """The bytes of one value that is not null."""
    if isinstance(kind, T.BooleanType):
        return b"\1" if value else b"\0"
    if fmt := _FORMATS.get(type(kind)):
        return struct.pack(fmt, value)
    if isinstance(kind, T.DecimalType):  # an unsigned 64-bit number
        return int(value).to_bytes(8, "big")
    if isinstance(kind, T.StringType | T.BinaryType):
        raw = value.encode() if isinstance(value, str) else bytes(value)
        return struct.pack(">I", len(raw)) + raw
    if isinstance(kind, T.ArrayType):
        return struct.pack(">I", len(value)) + b"".join(_optional(kind.containsNull, v, lambda v=v: encode(v, kind.elementType)) for v in value)
    if isinstance(kind, T.MapType):
        pairs = sorted(dict(value).items(), key=lambda x: encode(x[0], kind.keyType))
        return struct.pack(">I", len(pairs)) + b"".join(encode(k, kind.keyType) + _optional(kind.valueContainsNull, v, lambda v=v: encode(v, kind.valueType)) for k, v in pairs)
    if isinstance(kind, T.StructType):
        get = (lambda f: value[f]) if isinstance(value, dict | Row) else (lambda f: getattr(value, f))
        return b"".join(_optional(f.nullable, get(f.name), lambda f=f: encode(get(f.name), f.dataType)) for f in kind.fields)
    raise TypeError(f"no encoding for {kind.simpleString()}")


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("truncated input")
        self.at += n
        return self.data[self.at - n : self.at]

    def maybe(self, nullable: bool, kind: T.DataType) -> object:
        return None if nullable and not self.take(1)[0] else self.value(kind)

    def value(self, kind: T.DataType) -> object:
        if isinstance(kind, T.BooleanType):
            return self.take(1) != b"\0"
        if fmt := _FORMATS.get(type(kind)):
            return struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]
        if isinstance(kind, T.DecimalType):
            return int.from_bytes(self.take(8), "big")
        if isinstance(kind, T.StringType):
            return self.take(struct.unpack(">I", self.take(4))[0]).decode()
        if isinstance(kind, T.BinaryType):
            return self.take(struct.unpack(">I", self.take(4))[0])
        if isinstance(kind, T.ArrayType):
            return [self.maybe(kind.containsNull, kind.elementType) for _ in range(struct.unpack(">I", self.take(4))[0])]
        if isinstance(kind, T.MapType):
            found: dict = {}
            for _ in range(struct.unpack(">I", self.take(4))[0]):
                key = self.value(kind.keyType)
                found.setdefault(key, self.maybe(kind.valueContainsNull, kind.valueType))  # of equal keys the first counts
            return found
        if isinstance(kind, T.StructType):
            return {f.name: self.maybe(f.nullable, f.dataType) for f in kind.fields}
        raise TypeError(f"no encoding for {kind.simpleString()}")


def decode(data: bytes, kind: T.DataType) -> object:
    """The value of ``encode``'s bytes; structs become dicts."""
    reader = _Reader(data)
    value = reader.value(kind)
    if reader.at != len(data):
        raise ValueError("bytes left over")
    return value


def _for_arrow(value: object, kind: T.DataType) -> object:
    """``decode``'s value as Arrow takes it: maps as pairs."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_for_arrow(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return [(k, _for_arrow(v, kind.valueType)) for k, v in value.items()]
    if isinstance(kind, T.StructType):
        return {f.name: _for_arrow(value[f.name], f.dataType) for f in kind.fields}
    return value


def encoded(row: Column, kind: T.StructType) -> Column:
    """A struct column as its bytes (for interchange; by Arrow batches)."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else encode(r, kind) for r in rows.to_pylist()], pa.binary())

    return F.arrow_udf(run, T.BinaryType())(row)


def decoded(data: Column, kind: T.StructType) -> Column:
    """The reverse of ``encoded``."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if b is None else _for_arrow(decode(b, kind), kind) for b in values.to_pylist()], to_arrow_type(kind))

    return F.arrow_udf(run, kind)(data)


def encoded_size(value: object, kind: T.DataType) -> int:
    return len(encode(value, kind))
