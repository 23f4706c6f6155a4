"""What is known of a table besides its rows, and whether two tables can be compared by it.

Parquet tables carry no keys, constraints or SQL types, so those lie in a JSON sidecar (``_table.json``)
or in column metadata; all decisions here are on the driver and read no rows.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import families as fam


class PlanError(ValueError):
    """A table can't be handled; ``argument`` marks errors of the options rather than of the table."""

    def __init__(self, message: str, argument: bool = False) -> None:
        super().__init__(message)
        self.argument = argument


@dataclass(frozen=True)
class Column:
    name: str
    raw_type: str
    nullable: bool = True
    collation: str = ""
    default: str | None = None
    default_is_expression: bool = False
    auto_increment: bool = False
    on_update: str = ""
    charset: str = ""
    comment: str = ""
    generated: str = ""  # its expression
    stored: bool = False
    generated_readable: bool = True

    @property
    def info(self) -> fam.TypeInfo:
        return fam.classify(self.raw_type)

    @property
    def family(self) -> str:
        return self.info.family


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = True

    @property
    def primary(self) -> bool:
        return self.name.upper() == "PRIMARY"


@dataclass(frozen=True)
class TableSchema:
    table: str
    columns: tuple[Column, ...]
    indexes: tuple[Index, ...] = ()
    key: tuple[str, ...] = ()
    key_source: str = "none"  # primary, unique, explicit or none
    key_unique: bool = False
    engine: str = "parquet"
    auto_increment_counter: int | None = None
    default_collation: str = ""
    notes: tuple[str, ...] = field(default_factory=tuple)

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def constraints(self) -> list[tuple[str, ...]]:
        """Unique column tuples, the primary key's first."""
        return [i.columns for i in sorted(self.indexes, key=lambda i: not i.primary) if i.unique]

    def to_json(self) -> str:
        plain = {k: v for k, v in self.__dict__.items() if k not in ("columns", "indexes")}
        return json.dumps(plain | {"columns": [c.__dict__ for c in self.columns], "indexes": [i.__dict__ for i in self.indexes]})

    @staticmethod
    def from_json(text: str) -> TableSchema:
        found = json.loads(text)
        columns = tuple(Column(**c) for c in found.pop("columns"))
        indexes = tuple(Index(i["name"], tuple(i["columns"]), i.get("unique", True)) for i in found.pop("indexes", []))
        found |= {k: tuple(found[k]) for k in ("key", "notes") if k in found}
        return TableSchema(columns=columns, indexes=indexes, **found)


def introspect(df: DataFrame, table: str = "", indexes: tuple[Index, ...] = ()) -> TableSchema:
    """A schema from a DataFrame's types and metadata, with its key selected."""
    columns = tuple(Column(f.name, fam.raw_type(f), f.nullable, (f.metadata or {}).get("collation", ""), generated=(f.metadata or {}).get("generated", "")) for f in df.schema.fields)
    return select_key(TableSchema(table, columns, indexes))


# -- keys ------------------------------------------------------------------------------------------


def select_key(schema: TableSchema) -> TableSchema:
    """The primary key; else the first unique index by name whose columns can't be null; else none."""
    primary = [i for i in schema.indexes if i.primary]
    solid = lambda i: i.unique and all(not schema.column(c).nullable for c in i.columns)
    for index in primary or sorted((i for i in schema.indexes if solid(i)), key=lambda i: i.name):
        return replace(schema, key=index.columns, key_source="primary" if index.primary else "unique", key_unique=True)
    return replace(schema, key=(), key_source="none", key_unique=False)


def explicit_key(schema: TableSchema, names: list[str]) -> tuple[TableSchema, list[str]]:
    """``names`` as the key; it is unique if it is the primary key or a unique index without nulls, in
    order and in any case of letters."""
    by_lower = {c.name.lower(): c.name for c in schema.columns}
    missing = [n for n in names if n.lower() not in by_lower]
    if missing:
        raise PlanError(f"key column {missing[0]} not found in table {schema.table}", argument=True)
    key = tuple(by_lower[n.lower()] for n in names)
    lowered = tuple(n.lower() for n in key)
    unique = any(tuple(c.lower() for c in i.columns) == lowered and (i.primary or i.unique and all(not schema.column(c).nullable for c in i.columns)) for i in schema.indexes)
    warnings = [] if unique else [f"key ({', '.join(key)}) is not PRIMARY KEY or NOT NULL UNIQUE: rows are matched in groups"]
    return replace(schema, key=key, key_source="explicit", key_unique=unique), warnings


def nullable_key_warning(schema: TableSchema) -> list[str]:
    names = [n for n in schema.key if schema.column(n).nullable]
    return [f"key column {', '.join(names)} is nullable: rows without a key value sort first"] if names else []


def keys_agree(a: TableSchema, b: TableSchema) -> bool:
    return a.key == b.key and bool(a.key)


#: Families whose order follows from the value alone.
VALUE_ORDERED = fam.NUMERIC | {fam.DATE, fam.TIME, fam.DATETIME, fam.TIMESTAMP, fam.YEAR, fam.BYTES, fam.BIT}


LIST_TYPE = re.compile(r"\s*(?:enum|set)\s*\((.*)\)\s*", re.I | re.S)
MEMBER = re.compile(r"[ \t]*'((?:[^'\\]|\\.|'')*)'[ \t]*", re.S)
ESCAPED = re.compile(r"\\(.)|''", re.S)


def members(raw: str) -> list[str] | None:
    """Member texts of an enum or set type in order; None where the type can't be read. A backslash stands for the
    character after it, two quotes for one."""
    found = LIST_TYPE.fullmatch(raw)
    out: list[str] = []
    body = found[1].rstrip(" \t") if found else ""
    at = 0
    while at < len(body):
        one = MEMBER.match(body, at)
        if not one or one.end() < len(body) and body[one.end()] != ",":
            return None
        out.append(ESCAPED.sub(lambda m: m[1] or "'", one[1]))
        at = one.end() + 1
    return out if out and at > len(body) else None  # a comma is followed by a member


def key_order_compatible(a: TableSchema, b: TableSchema) -> tuple[bool, str]:
    """Whether both sides sort rows by the key alike; only what is known to do so passes."""
    if len(a.key) != len(b.key):
        return False, f"key column count differs ({len(a.key)} and {len(b.key)})"
    for left, right in zip(a.key, b.key):
        if left != right:
            return False, f"key columns differ ({left} and {right})"
        c, d = a.column(left), b.column(right)
        if c.family != d.family:
            return False, f"key column {left}: families differ ({c.family} and {d.family})"
        if c.family in VALUE_ORDERED:
            continue
        if c.family == fam.STR:
            known_text = c.raw_type.split("(")[0].strip().lower() in fam.FAMILY_OF_NAME
            if not known_text or c.collation.lower() != d.collation.lower():
                return False, f"key column {left}: collations differ ({c.collation or 'unknown'} and {d.collation or 'unknown'})"
        elif c.family in (fam.ENUM, fam.SET):
            ours, theirs = members(c.raw_type), members(d.raw_type)
            if ours is None or ours != theirs:
                return False, f"key column {left}: member lists differ or can't be read"
        else:
            return False, f"key column {left}: the order of {c.family} is not known"
    return True, ""


def range_addressable(a: TableSchema, b: TableSchema) -> tuple[bool, str]:
    fine, why = key_order_compatible(a, b)
    if not fine:
        return False, why
    listed = [n for n in a.key if a.column(n).family in (fam.ENUM, fam.SET)]
    return (False, f"key column {listed[0]} is an ENUM or SET: its order and its comparisons differ") if listed else (True, "")


# -- compatibility ---------------------------------------------------------------------------------


def ignore_columns(src: TableSchema, dst: TableSchema, ignored: list[str]) -> tuple[TableSchema, TableSchema]:
    """Both schemas without ``ignored``. With none ignored, columns must stand in the same order; else the
    destination's follow the source's."""
    if not ignored:
        return src, dst
    gone = {n.lower() for n in ignored}
    kept = [c for c in src.columns if c.name.lower() not in gone]
    if not kept:
        raise PlanError(f"table {src.table}: all columns are ignored", argument=True)
    theirs = {c.name: c for c in dst.columns if c.name.lower() not in gone}
    for c in kept:
        if c.name not in theirs:
            raise PlanError(f"column {c.name} not found on the destination")
    extra = [n for n in theirs if n not in {c.name for c in kept}]
    if extra:
        raise PlanError(f"column {extra[0]} of the destination is neither compared nor ignored")
    names = {c.name for c in kept}
    keep_index = lambda s: tuple(i for i in s.indexes if set(i.columns) <= names)
    return replace(src, columns=tuple(kept), indexes=keep_index(src)), replace(dst, columns=tuple(theirs[c.name] for c in kept), indexes=keep_index(dst))


def compatible(src: TableSchema, dst: TableSchema, strict: bool = False, tz_swap: bool = False) -> list[str]:
    """Warnings of a pair that can be compared column by column; an error if it can't be."""
    if len(src.columns) != len(dst.columns):
        raise PlanError(f"column count differs: src={len(src.columns)} ({', '.join(src.names)}) dst={len(dst.columns)} ({', '.join(dst.names)})")
    warnings = []
    for k, (c, d) in enumerate(zip(src.columns, dst.columns)):
        if c.name != d.name:
            raise PlanError(f"column {k}: names differ: src={c.name} dst={d.name}")
        types = f"{c.raw_type} and {d.raw_type}"
        if strict:
            if c.raw_type.lower() != d.raw_type.lower():
                raise PlanError(f"column {c.name}: types differ (strict): {types}")
        elif c.family == d.family:
            if c.family == fam.DECIMAL and c.info != d.info:
                warnings.append(f"column {c.name}: decimal width differs ({types}); values are compared after normalization")
            if c.family == fam.STR and c.collation and d.collation and c.collation != d.collation:
                warnings.append(f"column {c.name}: collation differs ({c.collation} and {d.collation}); bytes are compared")
        elif c.family in fam.NUMERIC and d.family in fam.NUMERIC:
            warnings.append(f"column {c.name}: numeric types differ ({types}); values are compared after normalization")
        elif {c.family, d.family} == {fam.DATETIME, fam.TIMESTAMP}:
            if not tz_swap:
                raise PlanError(f"column {c.name}: {types}: allow the time zone swap to compare them as UTC instants")
            warnings.append(f"column {c.name}: {types}: compared as UTC instants")
        else:
            raise PlanError(f"column {c.name}: type families differ: {c.family} and {d.family}")
    return warnings


def kinds(df: DataFrame, schema: TableSchema) -> list[tuple[str, fam.TypeInfo, T.DataType]]:
    """(name, family, Spark type) of a schema's columns in a DataFrame."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [(c.name, c.info, types[c.name]) for c in schema.columns]


def auto_increment_next(df: DataFrame, column: str, counter: int | None = None) -> DataFrame:
    """(next_value): the greater of the stored counter and the largest value plus one."""
    return df.agg(F.greatest(F.coalesce(F.max(column).cast("long") + 1, F.lit(1)), F.lit(counter or 1).cast("long")).alias("next_value"))
