"""Column families: which values are comparable, and how each is written canonically."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

INT, UINT, DECIMAL, FLOAT, DOUBLE = "INT", "UINT", "DECIMAL", "FLOAT", "DOUBLE"
DATE, TIME, DATETIME, TIMESTAMP, YEAR = "DATE", "TIME", "DATETIME", "TIMESTAMP", "YEAR"
ENUM, SET, STR, BYTES, JSON, BIT = "ENUM", "SET", "STR", "BYTES", "JSON", "BIT"
NUMERIC = frozenset({INT, UINT, DECIMAL, FLOAT, DOUBLE})

#: One tag byte a family; numeric families share one, as equal numbers must be equal bytes.
TAGS = {
    INT: 0x01,
    UINT: 0x01,
    DECIMAL: 0x01,
    FLOAT: 0x01,
    DOUBLE: 0x01,
    DATE: 0x06,
    TIME: 0x07,
    DATETIME: 0x08,
    TIMESTAMP: 0x09,
    YEAR: 0x0A,
    ENUM: 0x0B,
    SET: 0x0C,
    STR: 0x0D,
    BYTES: 0x0E,
    JSON: 0x0F,
    BIT: 0x10,
}
NULL_TAG = 0x00

#: The SQL type names of each family.
TYPE_NAMES = {
    INT: "tinyint smallint mediumint int integer bigint",
    DECIMAL: "decimal dec numeric",
    FLOAT: "float",
    DOUBLE: "double real",
    DATE: "date",
    TIME: "time",
    DATETIME: "datetime",
    TIMESTAMP: "timestamp",
    YEAR: "year",
    ENUM: "enum",
    SET: "set",
    STR: "char varchar tinytext text mediumtext longtext",
    BYTES: "binary varbinary tinyblob blob mediumblob longblob",
    JSON: "json",
    BIT: "bit",
}
FAMILY_OF_NAME = {name: family for family, names in TYPE_NAMES.items() for name in names.split()}
_TYPE = re.compile(r"\s*([a-z]+)\s*(?:\(([^)]*)\))?(.*)", re.S | re.I)


@dataclass(frozen=True)
class TypeInfo:
    family: str
    precision: int = 0
    scale: int = 0


def classify(raw: str) -> TypeInfo:
    """The family of a SQL column type; unknown types compare byte by byte, like strings."""
    found = _TYPE.match(raw)
    if not found:
        return TypeInfo(STR)
    name, spec, rest = found[1].lower(), found[2] or "", found[3].lower()
    family = FAMILY_OF_NAME.get(name, STR)
    if family == INT and "unsigned" in rest.split():
        return TypeInfo(UINT)
    numbers = [int(x) if x.strip().isdigit() else 0 for x in spec.split(",")] if spec.strip() else []
    if family == DECIMAL:
        precision, scale = (numbers + [0, 0])[:2]
        return TypeInfo(DECIMAL, precision, scale)
    if family in (DATETIME, TIMESTAMP, TIME):
        return TypeInfo(family, 0, numbers[0] if numbers else 0)
    return TypeInfo(family)


def of_field(field: T.StructField) -> TypeInfo:
    """The family of a DataFrame column: what its metadata says, else what its type implies."""
    meta = field.metadata or {}
    if "raw_type" in meta:
        return classify(meta["raw_type"])
    kind = field.dataType
    if "family" in meta:
        return TypeInfo(meta["family"])
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return TypeInfo(INT)
    if isinstance(kind, T.DecimalType):
        return TypeInfo(DECIMAL, kind.precision, kind.scale)
    if isinstance(kind, T.FloatType):
        return TypeInfo(FLOAT)
    if isinstance(kind, T.DoubleType):
        return TypeInfo(DOUBLE)
    if isinstance(kind, T.DateType):
        return TypeInfo(DATE)
    if isinstance(kind, T.DayTimeIntervalType):
        return TypeInfo(TIME, 0, 6)
    if isinstance(kind, T.TimestampNTZType):
        return TypeInfo(DATETIME, 0, 6)
    if isinstance(kind, T.TimestampType):
        return TypeInfo(TIMESTAMP, 0, 6)
    if isinstance(kind, T.BinaryType):
        return TypeInfo(BYTES)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return TypeInfo(JSON)
    return TypeInfo(STR)


#: What a type is called where no SQL type was given.
DEFAULT_RAW = {INT: "bigint", UINT: "bigint unsigned", FLOAT: "float", DOUBLE: "double", DATE: "date", TIME: "time(6)", DATETIME: "datetime(6)", TIMESTAMP: "timestamp(6)", YEAR: "year", STR: "text", BYTES: "longblob", JSON: "json", BIT: "bit(64)", ENUM: "enum", SET: "set"}


def raw_type(field: T.StructField) -> str:
    meta = field.metadata or {}
    if "raw_type" in meta:
        return meta["raw_type"]
    info = of_field(field)
    return f"decimal({info.precision},{info.scale})" if info.family == DECIMAL else DEFAULT_RAW[info.family]
