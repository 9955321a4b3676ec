"""Key order: the order of the big-endian byte encoding of a key, as column expressions.

Scans and limits follow it by default; it is not the natural order for signed numbers, floats and strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_columns(column: Column, kind: T.DataType, natural: bool = False) -> list[Column]:
    """What to sort by, ascending, so that rows come in key order.

    Signed integers: 0 and up, then negative ones. Floats: +0 to +inf, NaN, then -0, -1 ... -inf (Spark holds -0.0 and
    0.0 equal). Strings and bytes: by byte length, then by bytes. Arrays: by length, then element by element. Structs: field by field. Null first.
    """
    if natural:
        return [column]
    if isinstance(kind, T.BooleanType | T.DecimalType):
        return [column]
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return [column < 0, column]
    if isinstance(kind, T.FloatType | T.DoubleType):
        negative = (column < 0) & ~F.isnan(column)
        return [negative, F.abs(column)]
    if isinstance(kind, T.StringType):
        return [F.octet_length(column), F.encode(column, "UTF-8")]
    if isinstance(kind, T.BinaryType):
        return [F.octet_length(column), column]
    if isinstance(kind, T.ArrayType):
        element = F.transform(column, lambda x: F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order_columns(x, kind.elementType)))))
        return [F.size(column), element]
    if isinstance(kind, T.StructType):
        return [c for f in kind.fields for c in order_columns(column[f.name], f.dataType)]
    raise TypeError(f"no key order for {kind.simpleString()}")


def key_order(schema: T.StructType, key: list[str], natural: bool = False) -> list[Column]:
    """Sort columns for a key of one or more top-level columns."""
    return [c for name in key for c in order_columns(F.col(name), schema[name].dataType, natural)]


def _literals(value: object, kind: T.DataType, natural: bool) -> list[Column]:
    return order_columns(F.lit(value).cast(kind), kind, natural)


def at_least(schema: T.StructType, key: list[str], values: tuple, natural: bool = False) -> Column:
    """The key is ``values`` or comes after it."""
    return ~before(schema, key, values, natural)


def before(schema: T.StructType, key: list[str], values: tuple, natural: bool = False) -> Column:
    """The key comes before ``values``, component by component. Plain comparisons stay plain, so that scans can use them."""
    if len(values) != len(key):
        raise ValueError(f"the key has {len(key)} parts")
    kinds = [schema[k].dataType for k in key]
    if len(key) == 1 and isinstance(kinds[0], T.ByteType | T.ShortType | T.IntegerType | T.LongType) and not natural:
        c, v = F.col(key[0]), values[0]
        return ((c >= 0) & (c < v)) if v >= 0 else ((c >= 0) | (c < v))
    left = key_order(schema, key, natural)
    right = [x for v, kind in zip(values, kinds, strict=True) for x in _literals(v, kind, natural)]
    found = F.lit(False)
    for a, b in reversed(list(zip(left, right, strict=True))):
        found = (a < b) | (a.eqNullSafe(b) & found)
    return found


def order_value(value: object, kind: T.DataType, natural: bool = False) -> tuple | None:
    """A value's place in key order as something that Python compares like ``order_columns`` does; None where it cannot be told here."""
    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        return (value,)
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return (value,) if natural else (value < 0, value)
    if isinstance(kind, T.FloatType | T.DoubleType):
        number = (value != value, 0.0 if value != value else value)
        return number if natural else (value < 0, number[0], abs(number[1]))
    if isinstance(kind, T.StringType):
        data = value.encode()
        return (data,) if natural else (len(data), data)
    return None


def key_place(values: tuple | list | None, schema: T.StructType, key: list[str], natural: bool = False) -> tuple | None:
    """A whole key's place, part by part; None where one part cannot be told."""
    if values is None:
        return None
    places = [order_value(v, schema[k].dataType, natural) for k, v in zip(key, values, strict=True)]
    return None if None in places else tuple(places)
