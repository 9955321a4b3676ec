"""Key order, predicates, hashes and the codec."""

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.functions import binpack, hashing
from ledgerframe.functions.expr import Capture, Col, Lit, columns, compile_predicate
from ledgerframe.functions.numbering import numbered
from ledgerframe.functions.ordering import at_least, before, key_order


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        (T.IntegerType(), [0, 1, -1, 2**31 - 1, -(2**31), 77, -300]),
        (T.LongType(), [0, 5, -5, 2**63 - 1, -(2**63)]),
        (T.DoubleType(), [0.0, 1.5, -1.5, math.inf, -math.inf, 1e-300, -2.0]),
        (T.StringType(), ["", "b", "aa", "é", "Z", "a", "zzz", "日本"]),
        (T.BinaryType(), [b"", b"\xff", b"\x00\x01", b"a"]),
        (T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType(), False)]), [(1, "b"), (-1, "a"), (1, "aa"), (0, "")]),
    ],
)
def test_key_order_is_the_order_of_the_encoding(spark, kind, values):
    schema = T.StructType([T.StructField("k", kind, False)])
    df = spark.createDataFrame([(v,) for v in values], schema)
    as_value = (lambda v: {"a": v[0], "b": v[1]}) if isinstance(kind, T.StructType) else (lambda v: v)
    expected = sorted(values, key=lambda v: binpack.encode(as_value(v), kind))
    back = lambda k: tuple(k) if isinstance(kind, T.StructType) else bytes(k) if isinstance(kind, T.BinaryType) else k
    assert [back(r.k) for r in df.orderBy(*key_order(schema, ["k"])).collect()] == expected
    if isinstance(kind, T.StructType):
        return
    for i, bound in enumerate(expected):
        assert {back(r.k) for r in df.where(before(schema, ["k"], (bound,))).collect()} == set(expected[:i])
        assert {back(r.k) for r in df.where(at_least(schema, ["k"], (bound,))).collect()} == set(expected[i:])


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x" * 50).alias("v"))
    got = {r.k: r.n for r in numbered(df, [F.col("k")], "n", 10, parts=7).collect()}
    assert got == {k: k + 10 for k in range(5000)}
    assert numbered(df.where("false"), [F.col("k")], "n").count() == 0


ENTITY = "id long, flag boolean, i8 tinyint, i64 long, f float, d double, s string, opt int, tags array<string>, nums array<int>, scores map<string,int>, address struct<city:string,zip:string>, items array<struct<a:int>>"
ROWS = [
    (1, True, 1, 2**53 + 1, 1.5, 1.0, "a", 4, ["x", None], [1, 2], {"k": 1}, ("Rome", "1"), [(1,)]),
    (2, False, 2, 2**53, 2.5, float("nan"), "B", None, [], None, {}, ("Oslo", None), []),
    (3, None, None, None, None, None, None, None, None, None, None, None, None),
    (4, True, -1, -5, -0.0, float("-inf"), "é", 0, ["é"], [None], {"é": None}, (None, "z"), None),
]
C = Col
CASES = [
    (C("d") == 1.0, {1}), (C("d") == 1, set()), (C("d") != 1, {1, 2, 3, 4}), (C("opt") == None, {2, 3}), (C("opt") != 4, {2, 3, 4}), (C("d") == C("d"), {1, 3, 4}),  # noqa: E711
    (C("i64") > 2**53, set()), (C("d") < 5.0, {1, 4}), (C("s") > "a", {1, 4} - {1}), (C("s") > 1, set()), (C("flag") > Lit(False), set()), (~C("flag"), {2}), (~C("s"), set()),
    (C("opt") & C("flag"), set()), (C("opt") | C("flag"), {1, 4}), (C("flag") | (C("opt") > 1), {1, 4}), ((C("opt") > 100) | Lit(True), {1, 4}), (Lit(False) & (C("opt") > 1) | (C("id") == 2), {2}),
    (Lit("x").is_in(C("tags")), {1}), (Lit(None).is_in(C("tags")), {1}), (Lit("x").not_in(C("tags")), {2, 3, 4}), (C("opt").is_in(C("nums")), set()), (Lit(1).is_in(C("nums")), {1}), (Lit(1.0).is_in(C("nums")), set()),
    (Lit("k").is_in(C("scores")), {1}), (C("scores").get("k") == 1, {1}), (C("scores").get("é").is_null(), {1, 2, 3, 4}), (C("scores").get(1).is_null(), {1, 2, 3, 4}), (C("s").get("k").is_null(), {1, 2, 3, 4}),
    (C("address.city") == "Rome", {1}), (C("address").is_null(), {1, 2, 3, 4}), (C("items").is_null(), {1, 2, 3, 4}), (C("nope").is_null(), {1, 2, 3, 4}), (C("s").is_not_null() & (C("id") >= Capture(0)), {2, 4}),
    (C("s"), set()), (C("tags") == C("tags"), {1, 2, 3, 4}), (C("tags") == C("nums"), {3}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_predicate(spark, case):
    node, expected = CASES[case]
    df = spark.createDataFrame(ROWS, ENTITY)
    assert {r.id for r in df.where(compile_predicate(node, df.schema, (2,))).collect()} == expected


def test_strict_predicates_fail_on_errors_only(spark):
    df = spark.createDataFrame(ROWS, ENTITY)
    with pytest.raises(Exception, match="type error"):
        df.where(compile_predicate(C("opt") > 1, df.schema, strict=True)).collect()
    some = df.where(compile_predicate(C("opt").is_not_null() & (C("opt") > 1), df.schema, strict=True))
    assert [r.id for r in some.collect()] == [1]
    assert {r.id for r in df.where(compile_predicate(C("i64") > 2**53, df.schema, exact_ints=True)).collect()} == {1}
    with pytest.raises(IndexError):
        compile_predicate(C("id") == Capture(3), df.schema, (1,))
    assert columns((C("a") > 1) & ~C("b").is_null()) == {"a", "b"}


def test_hashes():
    assert hashing.fnv1a_64("") == 0xCBF29CE484222325 and hashing.fnv1a_64("a") == 0xAF63DC4C8601EC8C
    assert hashing.crc32c(b"123456789") == 0xE3069283 and hashing.crc32c(b"6789", hashing.crc32c(b"12345")) == 0xE3069283
    key = bytes(range(16))
    assert hashing.siphash_2_4(bytes(range(15)), *struct.unpack("<QQ", key)) == 0xA129CA6149BE45E5
    assert hashing.next_prefix(hashing.be64(255)) == hashing.be64(256) and hashing.from_be64(hashing.be64(7)) == 7


KIND = (
    T.StructType().add("a", T.LongType(), False).add("b", T.StringType()).add("c", T.ArrayType(T.IntegerType())).add("d", T.MapType(T.StringType(), T.DoubleType()))
    .add("e", T.StructType().add("x", T.BooleanType()).add("y", T.BinaryType())).add("f", T.DoubleType(), False)
)


@settings(max_examples=60, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.none() | st.text(), st.none() | st.lists(st.none() | st.integers(-9, 9)), st.none() | st.dictionaries(st.text(), st.none() | st.floats(allow_nan=False)), st.none() | st.fixed_dictionaries({"x": st.none() | st.booleans(), "y": st.none() | st.binary()}), st.floats(allow_nan=False))
def test_codec_round_trip(a, b, c, d, e, f):
    row = {"a": a, "b": b, "c": c, "d": d, "e": e, "f": f}
    data = binpack.encode(row, KIND)
    assert binpack.decode(data, KIND) == row
    with pytest.raises(ValueError):
        binpack.decode(data[:-1], KIND)


def test_percent_decoding_keeps_bad_escapes(spark, tmp_path):
    from ledgerframe.plans import catalogue

    urls = ["a%20b+c", "100%zz", "100%", "%4", "%C3%A9/x", "é%41", "%4z!", "%%41", None]
    want = ["a b c", "100%zz", "100%", "%4", "é x", "éA", "\x04!", "%A", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.decoded for r in catalogue.queries()["percent_decoding"](spark, str(tmp_path)).collect()} == dict(enumerate(want))
