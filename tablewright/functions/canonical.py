"""Canonical values as Column expressions: two values are equal exactly if their bytes are.

A value is one tag byte, eight bytes of length and the canonical text or bytes; null is the null tag
alone. Numbers of all families share one decimal grammar and one tag, so 1, 1.00 and 1e0 are equal, and no
number passes through a float on its way. Only canonical JSON needs Python (an Arrow-batched UDF).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import families as fam

#: The longest plain rendering of a number, and the largest power of ten that is rendered.
PLAIN_LENGTH, LARGEST_EXPONENT = 20, 1 << 60
#: Numbers that have no decimal form keep their names.
NOT_FINITE = {"NaN": "NaN", "Infinity": "+Inf", "-Infinity": "-Inf", "+Inf": "+Inf", "-Inf": "-Inf"}
NUMBER = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?$"


@dataclass(frozen=True)
class Options:
    """What counts as equal."""

    tolerance: float = 0.0
    trim_trailing: bool = True
    fold_case: bool = False
    normalize_json: bool = False
    tz_swap: bool = False

    def __post_init__(self) -> None:
        if not (math.isfinite(self.tolerance) and self.tolerance >= 0):
            raise ValueError(f"tolerance must be 0 or a finite positive number, not {self.tolerance}")


def _fail(text: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), text))


# -- numbers ---------------------------------------------------------------------------------------


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decimal_parts(text: Column) -> Column:
    """(negative, digits, power) of a decimal token: its value is digits x 10^power, digits without zeros
    at either end; zero is ("0", 0) and never negative. Malformed tokens raise an error."""
    part = lambda k: F.regexp_extract(text, NUMBER, k)
    valid = text.rlike(NUMBER) & text.rlike("^[+-]?[.]?[0-9]") & ~text.rlike("[eE][+-]?0*[1-9][0-9]{18}")
    exponent = F.when(part(4) == "", F.lit(0).cast("long")).otherwise(part(4).try_cast("long"))
    fields = F.struct((part(1) == "-").alias("negative"), F.concat(part(2), part(3)).alias("all"), (exponent - F.length(part(3))).alias("power"))

    def reduced(x: Column) -> Column:
        shown = F.ltrim(x["all"], F.lit("0"))
        digits = F.rtrim(shown, F.lit("0"))
        power = x["power"] + F.length(shown) - F.length(digits)
        zero = shown == ""
        return F.struct((x["negative"] & ~zero).alias("negative"), F.when(zero, "0").otherwise(digits).alias("digits"), F.when(zero, F.lit(0).cast("long")).otherwise(power).alias("power"))

    return F.when(valid, _bind(fields, reduced)).otherwise(_fail(text, "not a decimal number"))


def render_number(parts: Column) -> Column:
    """Plain while that takes at most PLAIN_LENGTH characters, else one digit, the rest, and an exponent."""
    negative, digits, power = parts["negative"], parts["digits"], parts["power"]
    n, shift = F.length(digits), -power
    small = lambda x: F.least(F.greatest(x, F.lit(0).cast("long")), F.lit(64).cast("long")).cast("int")
    whole = F.concat(digits, F.repeat(F.lit("0"), small(power)))
    inside = F.concat(F.substring(digits, F.lit(1), small(n - shift)), F.lit("."), F.substring(digits, small(n - shift) + 1, F.lit(PLAIN_LENGTH)))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), small(shift - n)), digits)
    exponent = power + n - 1
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    scientific = F.concat(F.substring(digits, F.lit(1), F.lit(1)), tail, F.lit("e"), F.when(exponent >= 0, "+").otherwise(""), exponent.cast("string"))
    out = (
        F.when(digits == "0", "0")
        .when(F.abs(power) > F.lit(LARGEST_EXPONENT), _fail(digits, "number out of range").cast("string"))
        .when((power >= 0) & (n + power <= PLAIN_LENGTH), whole)
        .when((power < 0) & (shift < n) & (n + 1 <= PLAIN_LENGTH), inside)
        .when((power < 0) & (shift >= n) & (shift + 2 <= PLAIN_LENGTH), below)
        .otherwise(scientific)
    )
    return F.concat(F.when(negative, "-").otherwise(""), out)


def canonical_number(text: Column) -> Column:
    """The canonical form of a decimal token; names of infinities and NaN pass."""

    def one(token: Column) -> Column:
        out = F.when(token.isNull(), None)
        for name, shown in NOT_FINITE.items():
            out = out.when(token == name, shown)
        return out.otherwise(_bind(decimal_parts(token), render_number))

    return _bind(text, one)


def canonical_decimal(value: Column, kind: T.DataType) -> Column:
    """Integers are canonical as they are; decimals of at most 18 digits need only lose the zeros at their
    end."""
    text = value.cast("string")
    if isinstance(kind, T.IntegralType):
        return text
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        if kind.scale == 0:
            return text
        short = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
        return F.when(short.isin("-0", ""), "0").otherwise(short)
    return F.when(text == "", "0").otherwise(canonical_number(text))


def on_grid(value: Column, tolerance: float) -> Column:
    """``value`` on the tolerance grid, halves away from zero; where the grid overflows, as it was."""
    if not tolerance:
        return value
    steps = F.round(value / F.lit(tolerance)) * F.lit(tolerance)
    keep = F.isnan(value) | F.isnan(steps) | (F.abs(steps) == F.lit(float("inf")))
    return F.when(keep, value).otherwise(steps)


def canonical_float(value: Column, tolerance: float = 0.0) -> Column:
    """Shortest decimal text, in the canonical grammar. From a thousandth up to ten million the text of a
    number is plain and has a zero at its end only as ``.0``; others take the general rendering."""
    placed = on_grid(value, tolerance)
    text, size = placed.cast("string"), F.abs(placed)
    short = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return F.when(size == 0, "0").when((size >= 0.001) & (size < 1e7), short).otherwise(canonical_number(text))


# -- time ------------------------------------------------------------------------------------------

TIME = r"^(-?)([0-9]{1,3}):([0-5][0-9]):([0-5][0-9])(?:\.([0-9]{1,6}))?$"


def time_micros(text: Column) -> Column:
    """Microseconds of ``[-]H:MM:SS[.f]``; anything else raises an error."""
    part = lambda k: F.regexp_extract(text, TIME, k)
    number = lambda k: part(k).cast("long")
    total = ((number(2) * 60 + number(3)) * 60 + number(4)) * 1_000_000 + F.rpad(part(5), 6, "0").cast("long")
    return F.when(text.isNull(), None).when(text.rlike(TIME), F.when(part(1) == "-", -total).otherwise(total)).otherwise(_fail(text, "not a time").cast("long"))


def _fraction(micros: Column) -> Column:
    shown = F.rtrim(F.lpad(micros.cast("string"), 6, "0"), F.lit("0"))
    return F.when(micros == 0, "").otherwise(F.concat(F.lit("."), shown))


def canonical_time(micros: Column) -> Column:
    size = F.abs(micros)
    two = lambda x: F.lpad((x % 60).cast("string"), 2, "0")
    seconds = F.floor(size / F.lit(1_000_000).cast("decimal(20,0)")).cast("long")
    hours = F.floor(seconds / F.lit(3600)).cast("long")
    minutes = F.floor(seconds / F.lit(60)).cast("long")
    text = F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(seconds), _fraction(size % 1_000_000))
    return F.concat(F.when(micros < 0, "-").otherwise(""), text)


def canonical_datetime(value: Column) -> Column:
    """Date, time and as much of the fraction as there is."""
    return value.cast("string")


# -- text, bits, documents -------------------------------------------------------------------------


def canonical_text(value: Column, options: Options = Options()) -> Column:
    text = F.regexp_replace(value, r"(?U)\s+\z", "") if options.trim_trailing else value
    return F.lower(text) if options.fold_case else text


def canonical_bits(value: Column) -> Column:
    """Bits from the first one on; all zero is one 0."""
    return F.coalesce(F.conv(F.hex(value), 16, 2), F.lit("0"))


def number_token(token: str) -> str:
    """The canonical form of one number token, for documents."""
    value = Decimal(token)
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    if not text:
        return "0"
    kept = text.rstrip("0")
    power = int(exponent) + len(text) - len(kept)
    if abs(power) > LARGEST_EXPONENT:
        raise ValueError(f"number out of range: {token}")
    n, out = len(kept), None
    if power >= 0 and n + power <= PLAIN_LENGTH:
        out = kept + "0" * power
    elif power < 0 and -power < n and n + 1 <= PLAIN_LENGTH:
        out = f"{kept[:power]}.{kept[power:]}"
    elif power < 0 and -power >= n and 2 - power <= PLAIN_LENGTH:
        out = "0." + "0" * (-power - n) + kept
    if out is None:
        out = f"{kept[0]}{'.' if n > 1 else ''}{kept[1:]}e{power + n - 1:+d}"
    return "-" * sign + out


class _Number(str):
    pass


def _compact(value: object) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_compact, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def canonical_document(text: str) -> str:
    """Sorted keys, no spaces, exact numbers; a document's types stay, text after it is ignored, the last
    of equal keys wins, and one number out of range fails the document."""
    number = lambda token: _Number(number_token(token))
    reader = json.JSONDecoder(parse_float=number, parse_int=number, parse_constant=_refuse)
    return _compact(reader.raw_decode(text.lstrip(" \t\r\n"))[0])


def _refuse(name: str) -> None:
    raise ValueError(f"not JSON: {name}")


@F.pandas_udf(T.StringType())
def _canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_document, na_action="ignore")


def canonical_json(value: Column) -> Column:
    return _canonical_json(value)


# -- columns and rows ------------------------------------------------------------------------------


def payload(value: Column, info: fam.TypeInfo, kind: T.DataType, options: Options = Options()) -> Column:
    """Canonical bytes of a value, without tag and length."""
    family = info.family
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value).cast("binary")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("string").cast("binary")
    if family in fam.NUMERIC:
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            text = canonical_float(value, options.tolerance if family in (fam.FLOAT, fam.DOUBLE) else 0.0)
        elif isinstance(kind, T.StringType):
            text = canonical_number(F.when((value == "") & F.lit(family == fam.DECIMAL), "0").otherwise(value))
        else:
            text = canonical_decimal(value, kind)
    elif family == fam.DATE:
        text = F.date_format(value, "yyyy-MM-dd") if not isinstance(kind, T.StringType) else value
    elif family == fam.TIME:
        if isinstance(kind, T.StringType):
            micros = time_micros(value)
        elif isinstance(kind, T.DayTimeIntervalType):
            micros = (F.extract(F.lit("DAY"), value).cast("long") * 24 + F.extract(F.lit("HOUR"), value)) * 3_600_000_000 + F.extract(F.lit("MINUTE"), value).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long")
        else:
            micros = value.cast("long")
        text = canonical_time(micros)
    elif family in (fam.DATETIME, fam.TIMESTAMP):
        text = canonical_datetime(value.cast("timestamp_ntz") if isinstance(kind, T.StringType) else value)
    elif family == fam.BYTES:
        return value.cast("binary")
    elif family == fam.BIT:
        text = canonical_bits(value) if isinstance(kind, T.BinaryType) else F.conv(value.cast("string"), 10, 2)
    elif family == fam.JSON:
        text = canonical_json(value) if options.normalize_json else value
    elif family == fam.STR:
        text = canonical_text(value.cast("string"), options)
    else:  # YEAR, ENUM, SET
        text = value.cast("string")
    return text.cast("binary")


def tag(family: str, options: Options = Options()) -> int:
    return fam.TAGS[fam.DATETIME] if family == fam.TIMESTAMP and options.tz_swap else fam.TAGS[family]


def framed(body: Column, family: str, options: Options = Options()) -> Column:
    """Tag, length and payload; null is the null tag alone."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(body).cast("long")), 16, "0"))
    full = F.concat(F.lit(bytes([tag(family, options)])), size, body)
    return F.when(body.isNull(), F.lit(bytes([fam.NULL_TAG]))).otherwise(full)


def tlv(value: Column, info: fam.TypeInfo, kind: T.DataType, options: Options = Options()) -> Column:
    return framed(payload(value, info, kind, options), info.family, options)


def canonical_row(columns: Sequence[tuple[Column, fam.TypeInfo, T.DataType]], options: Options = Options()) -> Column:
    """Canonical values one after another; lengths keep neighbours apart."""
    return F.concat(F.lit(b""), *[tlv(c, info, kind, options) for c, info, kind in columns])


def null_marks(values: Sequence[Column]) -> list[Column]:
    """Which values are null, as bits of one long for every 60 values: a hash passes over nulls."""
    out = []
    for at in range(0, len(values), 60):
        bits = [F.when(v.isNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, v in enumerate(values[at : at + 60])]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        out.append(total)
    return out


def payload_hash(payloads: Sequence[tuple[Column, str]], kind: str = "xxhash64", options: Options = Options()) -> Column:
    """A 64-bit hash of a canonical row as a long, from payloads and their families. The fast one chains
    the row's tags, which payloads are null, and the payloads, each hashed with its length, without putting them
    together; the other is the first half of the MD5 of the row's bytes."""
    if kind == "xxhash64":
        tags = F.lit(bytes(tag(family, options) for _, family in payloads))
        return F.xxhash64(tags, *null_marks([body for body, _ in payloads]), *[body for body, _ in payloads])
    if kind != "md5":
        raise ValueError(f"no such hash: {kind}")
    digest = F.md5(F.concat(F.lit(b""), *[framed(body, family, options) for body, family in payloads]))
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


# -- display ---------------------------------------------------------------------------------------


def literal(value: Column, info: fam.TypeInfo, kind: T.DataType) -> Column:
    """A value as a SQL literal."""
    family = info.family
    if family in fam.NUMERIC or family == fam.YEAR:
        text = value.cast("string")
    elif family == fam.BIT:
        text = F.concat(F.lit("b'"), canonical_bits(value) if isinstance(kind, T.BinaryType) else F.conv(value.cast("string"), 10, 2), F.lit("'"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("X'"), F.hex(value), F.lit("'"))
    else:
        shown = canonical_datetime(value) if family in (fam.DATETIME, fam.TIMESTAMP) else value.cast("string")
        escaped = F.replace(F.replace(shown, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
        text = F.concat(F.lit("'"), escaped, F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


#: The longest value shown whole, and how much of a longer one is shown before the dots.
SHOWN, SHORTENED = 80, 77


def display(value: Column, info: fam.TypeInfo, kind: T.DataType) -> Column:
    """A value for reports: long ones shortened, bytes in hex, numbers bare."""
    text = F.concat(F.lit("0x"), F.lower(F.hex(value))) if isinstance(kind, T.BinaryType) else canonical_datetime(value) if info.family in (fam.DATETIME, fam.TIMESTAMP) and not isinstance(kind, T.StringType) else value.cast("string")
    text = F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHORTENED), F.lit("..."))).otherwise(text)
    return F.coalesce(text, F.lit("NULL"))


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
