"""Pairs of one-column tables whose values are easily taken for equal, or for different."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.canonical import Options
from tablewright.operators import diff
from tablewright.plans import schema as schemas
from tablewright.sources.tables import with_indexes

SAME, DIFFERENT, ERROR = "OK", "DIFFERENT", "ERROR"


def column(values, kind, raw):
    return values, kind, raw


DAY = datetime.datetime(2024, 1, 1, 4, 0)
PAIRS = [
    ("datetime differs", (["2024-01-01 12:00:00"], "timestamp_ntz", "datetime"), (["2024-01-01 00:00:00"], "timestamp_ntz", "datetime"), {}, DIFFERENT),
    ("datetime and timestamp", (["2024-01-01 04:00:00"], "timestamp_ntz", "datetime"), (["2024-01-01 04:00:00"], "timestamp", "timestamp"), {}, ERROR),
    ("datetime and timestamp, swapped", (["2024-01-01 04:00:00"], "timestamp_ntz", "datetime"), (["2024-01-01 04:00:00"], "timestamp", "timestamp"), {"tz_swap": True}, SAME),
    ("small float drift", (["1.0"], "double", "double"), (["1.000000000001"], "double", "double"), {}, DIFFERENT),
    ("small float drift, tolerated", (["1.0"], "double", "double"), (["1.000000000001"], "double", "double"), {"tolerance": 1e-9}, SAME),
    ("large float drift, tolerated", (["1.0"], "double", "double"), (["1.01"], "double", "double"), {"tolerance": 1e-9}, DIFFERENT),
    ("large numbers on a fine grid", (["1e10", "1e12"], "double", "double"), (["2e10", "1e12"], "double", "double"), {"tolerance": 1e-9}, DIFFERENT),
    ("json raw", (['{"a":1,"b":2}'], "string", "json"), (['{"b":2.0,"a":1}'], "string", "json"), {}, DIFFERENT),
    ("json normalised", (['{"a":1,"b":2}'], "string", "json"), (['{"b":2.0,"a":1}'], "string", "json"), {"normalize_json": True}, SAME),
    ("json beyond doubles", (['{"a":9007199254740992}'], "string", "json"), (['{"a":9007199254740993}'], "string", "json"), {"normalize_json": True}, DIFFERENT),
    ("json types", (['{"n":1}'], "string", "json"), (['{"n":"1"}'], "string", "json"), {"normalize_json": True}, DIFFERENT),
    ("decimal widths", (["1.00", "-0.00", "0.10"], "decimal(10,2)", "decimal(10,2)"), (["1", "0", "0.1"], "decimal(12,3)", "decimal(12,3)"), {}, SAME),
    ("char and varchar", (["ab        "], "string", "char(10)"), (["ab"], "string", "varchar(10)"), {}, SAME),
    ("null and empty", ([None, ""], "string", "text"), (["", None], "string", "text"), {}, DIFFERENT),
    ("int and unsigned", (["1"], "int", "int"), (["1"], "decimal(20,0)", "bigint unsigned"), {}, SAME),
    ("int and unsigned, strict", (["1"], "int", "int"), (["1"], "decimal(20,0)", "bigint unsigned"), {"strict": True}, ERROR),
    ("bigint and double", (["1000000"], "bigint", "bigint"), (["1e6"], "double", "double"), {}, SAME),
    ("decimal and double", (["0.0000100000"], "decimal(20,10)", "decimal(20,10)"), (["0.00001"], "double", "double"), {}, SAME),
    ("beyond doubles", (["9007199254740993"], "bigint", "bigint"), (["9007199254740992"], "double", "double"), {}, DIFFERENT),
    ("text and int", (["1"], "string", "text"), (["1"], "int", "int"), {}, ERROR),
    ("fractions", (["2024-01-01 00:00:00.100"], "timestamp_ntz", "datetime(3)"), (["2024-01-01 00:00:00.010"], "timestamp_ntz", "datetime(3)"), {}, DIFFERENT),
    ("enum", (["a", "b"], "string", "enum('a','b')"), (["a", "b"], "string", "enum('b','a')"), {}, SAME),
    ("enum differs", (["a"], "string", "enum('a','b')"), (["b"], "string", "enum('a','b')"), {}, DIFFERENT),
    ("time", (["-01:02:03", "838:59:59.1"], "string", "time(6)"), (["-1:02:03.000", "838:59:59.100000"], "string", "time(6)"), {}, SAME),
    ("time differs", (["-01:02:03"], "string", "time(6)"), (["-01:02:04"], "string", "time(6)"), {}, DIFFERENT),
    ("negative zero", (["-0.0"], "double", "double"), (["0.0"], "double", "double"), {}, SAME),
]


def table(spark, values, kind, raw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v string")
    return df.withColumn("v", F.col("v").cast(kind)).withMetadata("v", {"raw_type": raw})


@pytest.mark.parametrize(("name", "src", "dst", "options", "expected"), PAIRS, ids=[p[0] for p in PAIRS])
def test_pair(spark, name, src, dst, options, expected):
    strict = options.get("strict", False)
    a, b = table(spark, *src), table(spark, *dst)
    s, d = (with_indexes(schemas.introspect(x, "t"), PRIMARY=("id",)) for x in (a, b))
    spec = diff.Spec(strict=strict, options=Options(**{k: v for k, v in options.items() if k != "strict"}))
    assert diff.compare("t", a, b, s, d, spec).status == expected


def test_bits_compare_by_value(spark):
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType())])
    a = spark.createDataFrame([(0, b"\x01"), (1, b"\x00")], kind).withMetadata("v", {"raw_type": "bit(1)"})
    b = spark.createDataFrame([(0, b"\x00\x01"), (1, b"\x00\x00")], kind).withMetadata("v", {"raw_type": "bit(16)"})
    s, d = (with_indexes(schemas.introspect(x, "t"), PRIMARY=("id",)) for x in (a, b))
    assert diff.compare("t", a, b, s, d).status == SAME


def test_large_values_and_neighbours(spark):
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    one = spark.createDataFrame([(0, b"x" * 65536, b"y" * 65536)], kind)
    other = spark.createDataFrame([(0, b"x" * 65536 + b"y", b"y" * 65535)], kind)
    s = with_indexes(schemas.introspect(one, "t"), PRIMARY=("id",))
    for kind_of_hash in ("xxhash64", "md5"):
        assert diff.compare("t", one, other, s, s, diff.Spec(hash=kind_of_hash)).status == DIFFERENT
        assert diff.compare("t", one, one, s, s, diff.Spec(hash=kind_of_hash, secure=True)).status == SAME


def test_collation_makes_a_key_unusable(spark):
    df = spark.createDataFrame([("a", 1), ("B", 2)], "k string, v int")
    marked = lambda c: with_indexes(schemas.introspect(df.withMetadata("k", {"raw_type": "varchar(9)", "collation": c}), "t"), PRIMARY=("k",))
    found = diff.compare("t", df, df, marked("x_bin"), marked("x_ci"))
    assert found.status == SAME and not found.keyed and any("multiset" in w for w in found.warnings)


def test_nested_values_and_intervals(spark):
    df = spark.createDataFrame([(1, [1.5, 2.0], datetime.timedelta(hours=-30, microseconds=5), Decimal("12345678901234567890.5"))], "id long, a array<float>, t interval day to second, d decimal(38,10)")
    s = with_indexes(schemas.introspect(df, "t"), PRIMARY=("id",))
    assert diff.compare("t", df, df, s, s).status == SAME
    moved = df.withColumn("t", F.col("t") + F.expr("interval 1 second"))
    assert diff.compare("t", df, moved, s, s).status == DIFFERENT


def test_empty_text_of_a_decimal_is_zero(spark):
    from tablewright.functions import canonical, families as fam

    df = spark.createDataFrame([("",), ("0.00",), ("1.50",), (None,)], "x string")
    made = df.select(canonical.payload(F.col("x"), fam.classify("decimal(10,2)"), df.schema["x"].dataType).cast("string").alias("p")).collect()
    assert [r["p"] for r in made] == ["0", "0", "1.5", None]
