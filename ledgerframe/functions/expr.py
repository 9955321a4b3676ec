"""The predicate language: a small expression tree compiled to a Catalyst expression with exactly its own null and type rules.

Values at run time are null, bool, int, double, string, list or map. Equality asks for equal kind and value (int 1 is not
double 1.0; null equals null; NaN equals nothing). Ordering compares numbers as doubles and strings by bytes; on null, bool, or mixed kinds it is
an error, as is NOT of anything but a bool. An error in a part that is evaluated (AND and OR stop early) drops the row in
lenient mode and fails the query in strict mode. A row is kept if the whole is true.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Expr:
    """A node. Comparison operators, ``&``, ``|`` and ``~`` build larger ones."""

    def __gt__(self, o): return Bin("GT", self, wrap(o))  # noqa: E704
    def __ge__(self, o): return Bin("GE", self, wrap(o))  # noqa: E704
    def __lt__(self, o): return Bin("LT", self, wrap(o))  # noqa: E704
    def __le__(self, o): return Bin("LE", self, wrap(o))  # noqa: E704
    def __eq__(self, o): return Bin("EQ", self, wrap(o))  # noqa: E704
    def __ne__(self, o): return Bin("NEQ", self, wrap(o))  # noqa: E704
    def __and__(self, o): return Bin("AND", self, wrap(o))  # noqa: E704
    def __or__(self, o): return Bin("OR", self, wrap(o))  # noqa: E704
    def __invert__(self): return Un("NOT", self)  # noqa: E704
    def is_in(self, o): return Bin("IN", self, wrap(o))  # noqa: E704
    def not_in(self, o): return Bin("NOT_IN", self, wrap(o))  # noqa: E704
    def is_null(self): return Un("IS_NULL", self)  # noqa: E704
    def is_not_null(self): return Un("IS_NOT_NULL", self)  # noqa: E704
    def get(self, key): return Bin("MAP_GET", self, wrap(key))  # noqa: E704
    __hash__ = object.__hash__


@dataclass(eq=False)
class Lit(Expr):
    value: object


@dataclass(eq=False)
class Col(Expr):
    """A column by its dotted name; one that is not there is null."""

    name: str


@dataclass(eq=False)
class Capture(Expr):
    """A bound parameter by its index."""

    index: int


@dataclass(eq=False)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(eq=False)
class Un(Expr):
    op: str
    child: Expr


def wrap(value: object) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


#: How each kind of node is told in a serialised tree.
_TAGS = {"BIN": Bin, "UN": Un, "LIT": Lit, "COL": Col, "CAPTURE": Capture}
_OPERATIONS = {"BIN": frozenset("GT GE LT LE EQ NEQ AND OR IN NOT_IN MAP_GET".split()), "UN": frozenset("NOT IS_NULL IS_NOT_NULL".split())}


def dump(node: Expr, captures: tuple = ()) -> str:
    """A predicate as JSON text: its captures, then its tree."""

    def tree(x: Expr) -> list:
        if isinstance(x, Bin):
            return ["BIN", x.op, tree(x.left), tree(x.right)]
        if isinstance(x, Un):
            return ["UN", x.op, tree(x.child)]
        return next([tag, getattr(x, field)] for tag, field in (("LIT", "value"), ("COL", "name"), ("CAPTURE", "index")) if isinstance(x, _TAGS[tag]))

    return json.dumps({"captures": list(captures), "tree": tree(node)})


def parse(text: str) -> tuple[Expr, tuple]:
    """The predicate and the captures of ``dump``'s text. Anything else raises ValueError."""

    def node(x: object) -> Expr:
        if not isinstance(x, list) or not x or x[0] not in _TAGS:
            raise ValueError(f"no node: {x!r}")
        tag, *parts = x
        if tag in _OPERATIONS:
            if len(parts) != (3 if tag == "BIN" else 2) or parts[0] not in _OPERATIONS[tag]:
                raise ValueError(f"no {tag} node: {parts!r}")
            return _TAGS[tag](parts[0], *map(node, parts[1:]))
        kinds = {"LIT": str | float | int | bool | None, "COL": str, "CAPTURE": int}[tag]
        if len(parts) != 1 or not isinstance(parts[0], kinds):
            raise ValueError(f"no {tag} node: {parts!r}")
        return _TAGS[tag](parts[0])

    found = json.loads(text)
    if not isinstance(found, dict) or not isinstance(found.get("captures"), list):
        raise ValueError("captures and a tree are needed")
    return node(found.get("tree")), tuple(found["captures"])


def columns(node: Expr) -> set[str]:
    """The columns that an expression reads."""
    if isinstance(node, Col):
        return {node.name}
    if isinstance(node, Bin):
        return columns(node.left) | columns(node.right)
    return columns(node.child) if isinstance(node, Un) else set()


@dataclass
class _Value:
    """A compiled node: its kind (of the seven), the value, whether evaluating it is an error, and element types of collections."""

    kind: str
    value: Column
    error: Column
    of: T.DataType | None = None


_INTS, _DOUBLES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)


def _kind(t: T.DataType) -> str:
    for kinds, name in ((T.BooleanType, "bool"), (_INTS, "int"), (_DOUBLES, "double"), (T.StringType, "string"), (T.MapType, "map")):
        if isinstance(t, kinds):
            return name
    if isinstance(t, T.ArrayType):
        return "null" if isinstance(t.elementType, T.StructType) else "list"
    return "null"  # structs, and types the language does not have


def _typed(column: Column, t: T.DataType, error: Column) -> _Value:
    kind = _kind(t)
    if kind == "null":
        return _Value("null", F.lit(None), error)
    if kind in ("int", "double"):
        column = column.cast("long" if kind == "int" else "double")
    return _Value(kind, column, error, t)


class Compiler:
    """Compiles trees over one schema. ``exact_ints`` compares two integers as such instead of as doubles."""

    def __init__(self, schema: T.StructType, captures: tuple = (), exact_ints: bool = False) -> None:
        self.schema, self.captures, self.exact_ints = schema, captures, exact_ints

    def _literal(self, v: object) -> _Value:
        none = F.lit(False)
        if v is None:
            return _Value("null", F.lit(None), none)
        for cls, kind, t in ((bool, "bool", T.BooleanType()), (int, "int", T.LongType()), (float, "double", T.DoubleType()), (str, "string", T.StringType())):
            if isinstance(v, cls):
                return _Value(kind, F.lit(v).cast(t), none, t)
        raise TypeError(f"no literal of {type(v).__name__}")

    def _column(self, name: str) -> _Value:
        t: T.DataType = self.schema
        for part in name.split("."):
            if not isinstance(t, T.StructType) or part not in t.fieldNames():
                return _Value("null", F.lit(None), F.lit(False))
            t = t[part].dataType
        return _typed(F.col(name), t, F.lit(False))

    def value(self, node: Expr) -> _Value:
        if isinstance(node, Lit):
            return self._literal(node.value)
        if isinstance(node, Col):
            return self._column(node.name)
        if isinstance(node, Capture):
            if not 0 <= node.index < len(self.captures):
                raise IndexError(f"capture {node.index} of {len(self.captures)}")
            return self._literal(self.captures[node.index])
        if isinstance(node, Un):
            return self._unary(node.op, self.value(node.child))
        a, b = self.value(node.left), self.value(node.right)
        return getattr(self, f"_{node.op.lower()}")(a, b)

    def _unary(self, op: str, x: _Value) -> _Value:
        if op == "NOT":
            if x.kind != "bool":
                return _Value("bool", F.lit(False), F.lit(True))
            return _Value("bool", ~x.value, x.error | x.value.isNull(), T.BooleanType())
        found = x.value.isNull() if op == "IS_NULL" else x.value.isNotNull()
        return _Value("bool", found, x.error, T.BooleanType())

    def _same(self, a: _Value, b: _Value) -> Column:
        """Equal kind and value."""
        if "null" in (a.kind, b.kind) or a.kind != b.kind:
            return a.value.isNull() & b.value.isNull()
        if a.kind == "double":
            return a.value.eqNullSafe(b.value) & ~F.coalesce(F.isnan(a.value), F.lit(False))
        if a.kind == "map":
            if a.of != b.of:
                return a.value.isNull() & b.value.isNull()
            return F.sort_array(F.map_entries(a.value)).eqNullSafe(F.sort_array(F.map_entries(b.value)))
        if a.kind == "list" and _kind(a.of.elementType) != _kind(b.of.elementType):
            return (a.value.isNull() & b.value.isNull()) | F.coalesce((F.size(a.value) == 0) & (F.size(b.value) == 0), F.lit(False))
        return a.value.eqNullSafe(b.value)

    def _order(self, a: _Value, b: _Value, compare) -> _Value:
        error = a.error | b.error
        if a.kind in ("int", "double") and b.kind in ("int", "double"):
            x, y = a.value, b.value
            if not (self.exact_ints and a.kind == b.kind == "int"):
                x, y = x.cast("double"), y.cast("double")
                found = compare(x, y) & ~F.isnan(x) & ~F.isnan(y)
            else:
                found = compare(x, y)
        elif a.kind == b.kind == "string":
            found = compare(a.value, b.value)
        else:
            return _Value("bool", F.lit(False), F.lit(True), T.BooleanType())
        return _Value("bool", F.coalesce(found, F.lit(False)), error | a.value.isNull() | b.value.isNull(), T.BooleanType())

    def _gt(self, a, b): return self._order(a, b, lambda x, y: x > y)  # noqa: E704
    def _ge(self, a, b): return self._order(a, b, lambda x, y: x >= y)  # noqa: E704
    def _lt(self, a, b): return self._order(a, b, lambda x, y: x < y)  # noqa: E704
    def _le(self, a, b): return self._order(a, b, lambda x, y: x <= y)  # noqa: E704

    def _eq(self, a: _Value, b: _Value) -> _Value:
        return _Value("bool", self._same(a, b), a.error | b.error, T.BooleanType())

    def _neq(self, a: _Value, b: _Value) -> _Value:
        return _Value("bool", ~self._same(a, b), a.error | b.error, T.BooleanType())

    @staticmethod
    def _true(x: _Value) -> Column:
        return F.coalesce(x.value, F.lit(False)) if x.kind == "bool" else F.lit(False)

    def _and(self, a: _Value, b: _Value) -> _Value:
        left, right = self._true(a), self._true(b)
        return _Value("bool", left & right, a.error | (left & b.error), T.BooleanType())

    def _or(self, a: _Value, b: _Value) -> _Value:
        left, right = self._true(a), self._true(b)
        return _Value("bool", left | right, a.error | (~left & b.error), T.BooleanType())

    def _in(self, a: _Value, b: _Value) -> _Value:
        error = a.error | b.error
        if b.kind == "list":
            found = F.exists(b.value, lambda x: self._same(_typed(x, b.of.elementType, F.lit(False)), a))
        elif b.kind == "map":
            keys = F.map_keys(b.value)
            found = F.exists(keys, lambda x: self._same(_typed(x, b.of.keyType, F.lit(False)), a))
        else:
            found = F.lit(False)
        return _Value("bool", F.coalesce(found, F.lit(False)), error, T.BooleanType())

    def _not_in(self, a: _Value, b: _Value) -> _Value:
        found = self._in(a, b)
        return _Value("bool", ~found.value, found.error, T.BooleanType())

    def _map_get(self, a: _Value, b: _Value) -> _Value:
        error = a.error | b.error
        if a.kind != "map" or _kind(a.of.keyType) != b.kind:
            return _Value("null", F.lit(None), error)
        return _typed(F.try_element_at(a.value, b.value.cast(a.of.keyType)), a.of.valueType, error)


def compile_predicate(node: Expr, schema: T.StructType, captures: tuple = (), strict: bool = False, exact_ints: bool = False) -> Column:
    """A boolean column that is never null: the rows to keep. strict: an error fails the query instead of dropping the row."""
    found = Compiler(schema, captures, exact_ints).value(node)
    keep = Compiler._true(found)
    if strict:
        return F.when(found.error, F.raise_error(F.lit("type error in a predicate")).cast("boolean")).otherwise(keep)
    return keep & ~found.error
