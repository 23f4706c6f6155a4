import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import canonical as c
from tablewright.functions import families as fam

NUMBERS = [
    ("0", "0"), ("-0", "0"), ("0.000", "0"), ("1.00", "1"), ("-1.50", "-1.5"), ("007", "7"), ("1e6", "1000000"), ("+.5", "0.5"), ("5.", "5"),
    ("0.0000100000", "0.00001"), ("1e20", "1e+20"), ("1e19", "10000000000000000000"), ("123456789012345678901", "1.23456789012345678901e+20"),
    ("1e100000000", "1e+100000000"), ("-1.2E-3", "-0.0012"), ("1e-19", "1e-19"), ("1e-18", "0.000000000000000001"), ("9007199254740993", "9007199254740993"),
    ("NaN", "NaN"), ("Infinity", "+Inf"), ("-Infinity", "-Inf"),
]


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_number_grammar(spark):
    assert column(spark, [a for a, _ in NUMBERS], T.StringType(), c.canonical_number) == [b for _, b in NUMBERS]
    assert [c.number_token(a) for a, _ in NUMBERS if a[-1].isdigit()] == [b for a, b in NUMBERS if a[-1].isdigit()]
    assert column(spark, [None], T.StringType(), c.canonical_number) == [None]


@pytest.mark.parametrize("bad", ["", "abc", "1.2.3", ".", "--1", "1e", "1e99999999999999999999", "1e2000000000000000000"])
def test_malformed_numbers_fail(spark, bad):
    with pytest.raises(Exception):
        column(spark, [bad], T.StringType(), c.canonical_number)


@settings(max_examples=200, deadline=None)
@given(st.integers(-(10**25), 10**25), st.integers(-30, 30))
def test_tokens_keep_their_value(digits, power):
    token = c.number_token(f"{digits}e{power}")
    assert decimal.Decimal(token) == decimal.Decimal(f"{digits}e{power}")
    assert c.number_token(token) == token


def test_families_share_numbers(spark):
    df = spark.sql("SELECT 1000000 AS i, cast(1000000 AS decimal(20,3)) AS d, cast(1e6 AS double) AS f, cast(1e6 AS float) AS g, cast(0.00001 AS double) AS s, cast(0.00001 AS decimal(20,10)) AS t")
    one = df.select(*[c.tlv(F.col(f.name), fam.of_field(f), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert one["i"] == one["d"] == one["f"] == one["g"] and one["s"] == one["t"]


def test_floats(spark):
    values = [0.0, -0.0, 1.0, -2.5, 1e7, 12345678.9, 1e-5, 0.001, 1e22, 5e-324, float("nan"), float("inf"), 0.1 + 0.2]
    assert column(spark, values, T.DoubleType(), c.canonical_float) == ["0", "0", "1", "-2.5", "10000000", "12345678.9", "0.00001", "0.001", "1e+22", "4.9e-324", "NaN", "+Inf", "0.30000000000000004"]
    assert column(spark, [1.0, 1.0 + 1e-12, 1.26, -1.25], T.DoubleType(), lambda v: c.canonical_float(v, 0.5)) == ["1", "1", "1.5", "-1.5"]
    assert column(spark, [1e308], T.DoubleType(), lambda v: c.on_grid(v, 1e-9)) == [1e308]
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            c.Options(tolerance=bad)


def test_time(spark):
    texts = ["838:59:59.999999", "-838:59:59", "0:00:00", "01:02:03.100", "1:02:03.01", "-00:00:00.000001"]
    shown = column(spark, texts, T.StringType(), lambda v: c.canonical_time(c.time_micros(v)))
    assert shown == ["838:59:59.999999", "-838:59:59", "0:00:00", "1:02:03.1", "1:02:03.01", "-0:00:00.000001"]
    for bad in ("1:60:00", "1234:00:00", "1:2:3", "1:02:03.", "x"):
        with pytest.raises(Exception):
            column(spark, [bad], T.StringType(), c.time_micros)


def test_text_bits_and_datetimes(spark):
    assert column(spark, ["a \t　\n", " b", "", None, "C"], T.StringType(), c.canonical_text) == ["a", " b", "", None, "C"]
    assert column(spark, ["Cc "], T.StringType(), lambda v: c.canonical_text(v, c.Options(fold_case=True))) == ["cc"]
    assert column(spark, [b"\x00\x05", b"\x00", b"\xff"], T.BinaryType(), c.canonical_bits) == ["101", "0", "11111111"]
    stamps = ["2024-01-02 03:04:05.100", "2024-01-02 03:04:05.010", "2024-01-02 03:04:05"]
    assert column(spark, stamps, T.StringType(), lambda v: c.canonical_datetime(v.cast("timestamp_ntz"))) == ["2024-01-02 03:04:05.1", "2024-01-02 03:04:05.01", "2024-01-02 03:04:05"]


def test_json(spark):
    pairs = [('{"b": 2.0, "a": 1}', '{"a":1,"b":2}'), ('{"n":"1"}', '{"n":"1"}'), ('[1e3, 9007199254740993, true, null]', "[1000,9007199254740993,true,null]"), ('{"a":1,"a":2} rest', '{"a":2}'), ('"é"', '"é"')]
    assert column(spark, [a for a, _ in pairs] + [None], T.StringType(), c.canonical_json) == [b for _, b in pairs] + [None]
    for bad in ("NaN", '{"a":1e9999999999999999999}', "{"):
        with pytest.raises(Exception):
            column(spark, [bad], T.StringType(), c.canonical_json)


def test_rows_keep_neighbours_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, ""), ("", None), ("NULL", "c")], "a string, b string")
    info = fam.TypeInfo(fam.STR)
    rows = [r["x"] for r in df.select(c.canonical_row([(F.col(n), info, T.StringType()) for n in "ab"]).alias("x")).collect()]
    assert len(set(rows)) == 5
    assert rows[2] == b"\x00" + b"\x0d" + b"\x00" * 8


def test_classify():
    assert fam.classify("BIGINT(20) unsigned zerofill").family == fam.UINT
    assert fam.classify("decimal(10, 2)") == fam.TypeInfo(fam.DECIMAL, 10, 2)
    assert fam.classify("datetime(3)") == fam.TypeInfo(fam.DATETIME, 0, 3)
    assert fam.classify("geometry").family == fam.STR
    assert fam.classify("enum('a','b')").family == fam.ENUM


def test_literals_and_display(spark):
    df = spark.createDataFrame([("it's\\", b"\x01\xff", "x" * 100)], "s string, b binary, l string")
    row = df.select(
        c.literal(F.col("s"), fam.TypeInfo(fam.STR), T.StringType()).alias("s"),
        c.literal(F.col("b"), fam.TypeInfo(fam.BYTES), T.BinaryType()).alias("b"),
        c.display(F.col("l"), fam.TypeInfo(fam.STR), T.StringType()).alias("l"),
    ).first()
    assert row["s"] == "'it''s\\\\'" and row["b"] == "X'01FF'" and row["l"] == "x" * 77 + "..."
    assert c.quote_identifier("a`b") == "`a``b`"
