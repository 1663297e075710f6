"""Typed values and their conversions as columns.

Types: str, real, int, datetime, bool, and any for an untyped path (text whose user decides).  Missing text is the empty
text.  Reading a number takes the longest numeric prefix, 0 if there is none.  A datetime is a struct of a timestamp (in
the session's zone; null if it is no datetime) and whether it has no time of day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In the order of generality: the common type of two is the earlier one.
LADDER = ("str", "real", "int", "datetime", "bool", "any")


@dataclass(frozen=True)
class Val:
    col: Column
    type: str
    #: The value of a literal.
    literal: object = None
    #: A column of text or times as the source has it, perhaps null, for filters that a scan can use.
    raw: Column | None = None


def common(*types: str) -> str:
    found = min(types, key=LADDER.index)
    return "str" if found == "any" else found


def of_column(col: Column, kind: T.DataType) -> Val:
    """A source column as a value; text is untyped, other kinds keep their own."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Val(col.cast("long"), "int")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Val(col.cast("double"), "real")
    if isinstance(kind, T.BooleanType):
        return Val(col, "bool")
    if isinstance(kind, T.DateType):
        return Val(_datetime(col.cast("timestamp"), F.lit(True)), "datetime", raw=col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Val(_datetime(col.cast("timestamp"), F.lit(False)), "datetime", raw=col)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return Val(F.coalesce(F.to_json(col), F.lit("")), "any")
    raw = col if isinstance(kind, T.StringType) else None
    return Val(F.coalesce(col.cast("string"), F.lit("")), "any", raw=raw)


def _datetime(ts: Column, dateonly: Column) -> Column:
    return F.struct(ts.alias("ts"), dateonly.alias("dateonly"))


def to_real(text: Column) -> Column:
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def to_int(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def general(value: Column) -> Column:
    """A real as text with six significant digits and no needless zeros."""
    shown = F.format_string("%.5e", value)
    digits = F.regexp_replace(F.split_part(shown, F.lit("e"), F.lit(1)), r"\.?0+$", "")
    power = F.split_part(shown, F.lit("e"), F.lit(2)).try_cast("int")
    plain = F.regexp_replace(shown.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .when(value == 0, F.lit("0"))
        .when((power < -4) | (power >= 6), F.concat(digits, F.lit("e"), F.split_part(shown, F.lit("e"), F.lit(2))))
        .otherwise(plain)
    )


def trimmed(value: Column, places: int = 10) -> Column:
    """A real with so many decimals, trailing zeros dropped but for one."""
    shown = F.format_string(f"%.{places}f", value)
    shown = F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", ".0") if places else shown
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(shown)
    )


def parse_datetime(text: Column) -> Column:
    """Lenient ``Y-M-D[ H:M:S[.fraction]]``: two-digit years, carried units, am or pm; else no datetime."""
    pattern = r"^\s*(\d+)-(\d+)-(\d+)[^ ]*(?: +(\d+):(\d+):(\d+)([ap]m|[AP]M)?(?:[.:](\d+))?[^ ]*)?\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    number = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    year = F.when(number(1) <= 49, number(1) + 2000).when(number(1) <= 99, number(1) + 1900).otherwise(number(1))
    has_time = part(4) != ""
    digits = F.rpad(part(8), 5, "0")
    fraction = F.substring(digits, 1, 4).try_cast("int") + F.when(F.substring(digits, 5, 1) > "5", 1).otherwise(0)
    fraction = F.when(part(8) != "", fraction).otherwise(0)
    hours = number(4) + F.floor(number(5) / 60 + 0)
    hours = F.when(F.lower(text).contains("pm") & (hours < 12), hours + 12).otherwise(hours)
    seconds = hours * 3600 + (number(5) % 60) * 60 + number(6)
    day = F.try_make_timestamp(year, number(2), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    micros = F.unix_micros(day) + (
        ((number(3) - 1).cast("long") * 86400 + F.when(has_time, seconds).otherwise(0)) * 1_000_000
        + F.when(has_time, fraction).otherwise(0).cast("long") * 100
    )
    good = (part(1) != "") & number(2).between(1, 12) & number(3).between(1, 31) & (year <= 2049)
    return _datetime(F.when(good, F.timestamp_micros(micros)), good & ~has_time)


def show_datetime(value: Column) -> Column:
    ts = value["ts"]
    fraction = F.date_format(ts, "SSSS")
    full = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(
        F.when(value["dateonly"], F.date_format(ts, "yyyy-MM-dd")).otherwise(
            F.when(fraction == "0000", full).otherwise(F.concat(full, F.lit("."), fraction))
        ),
        F.lit(""),
    )


def epoch(value: Column) -> Column:
    return F.coalesce(F.unix_micros(value["ts"]) / 1_000_000, F.lit(-1.0))


def convert(value: Val, to: str) -> Column:
    """The value's column as another type."""
    col, kind = value.col, value.type
    if kind == to or (kind == "any" and to == "str") or to == "any":
        return col
    if to == "real":
        if kind in ("str", "any"):
            return to_real(col)
        return epoch(col) if kind == "datetime" else col.cast("double")
    if to == "int":
        if kind in ("str", "any"):
            return to_int(col)
        if kind == "datetime":
            return F.floor(epoch(col)).cast("long")
        if kind == "real":
            return F.coalesce(col.try_cast("long"), F.lit(0).cast("long"))
        return col.cast("long")
    if to == "bool":
        if kind in ("str", "any"):
            return (col != "") & (col != "false") & ~col.startswith("0")
        return F.lit(False) if kind == "datetime" else col != 0
    if to == "datetime":
        if kind in ("str", "any"):
            return parse_datetime(col)
        if kind == "bool":
            return _datetime(F.lit(None).cast("timestamp"), F.lit(False))
        return _datetime(F.timestamp_micros((col * 1_000_000).cast("long")), F.lit(False))
    if kind == "real":
        return general(col)
    if kind == "datetime":
        return show_datetime(col)
    return col.cast("string")


def rendered(value: Val) -> Column:
    """The value as text in an output file."""
    if value.type == "real":
        return trimmed(value.col)
    return F.coalesce(convert(value, "str"), F.lit(""))


def output(value: Val) -> Column:
    """The value as a result column: datetimes as text, others as they are."""
    return show_datetime(value.col) if value.type == "datetime" else value.col
