"""Per-cell rules as Column expressions: predicates, conversions, rendering and CSV quoting.

Everything here stays in the JVM. Predicates and conversions take text columns and never raise; a conversion gives
NULL for text it does not accept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabflow.types import LogicalType

# Accepted text forms.
BLANK = r"(?U)^\s*$"
BOOL = r"(?i)^(?U:[\s\x00]*)(true|false)(?U:[\s\x00]*)$"
LONG = r"^\s*[+-]?\d+\s*$"
NUMBER = r"(?:\d[\d,]*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
FLOAT = rf"^\s*[+-]?{NUMBER}\s*$"
ANY_NUMBER = (
    rf"^\s*(?:[+-]?{NUMBER}|{NUMBER}\s*[+-]|\({NUMBER}\s*\)"
    rf"|¤\s*[+-]?{NUMBER}|[+-]?¤\s*{NUMBER}|[+-]?{NUMBER}\s*¤|\(¤\s*{NUMBER}\s*\))\s*$"
    r"|(?i)^(?U:\s*)[+-]?(?:nan|infinity)(?U:\s*)$"
)
SPECIAL_NUMBER = r"(?i)^(?U:\s*)[+-]?(?:nan|infinity)(?U:\s*)$"
_D = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_X = (
    r"\{0x[0-9a-f]{1,8},0x[0-9a-f]{1,4},0x[0-9a-f]{1,4},"
    r"\{0x[0-9a-f]{1,2}(?:,0x[0-9a-f]{1,2}){7}\}\}"
)
GUID_HEX = r"(?i)^(?U:\s*)[0-9a-f]{32}(?U:\s*)$"
GUID_PLAIN = rf"(?i)^(?U:\s*)(?:[0-9a-f]{{32}}|{_D}|\{{{_D}\}}|\({_D}\))(?U:\s*)$"
GUID_X = rf"(?i)^(?U:\s*){_X}(?U:\s*)$"
_TIME = r"(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,7})?)?)"
_AMPM = r"(?:\s*([AaPp][Mm]))?"
_MONTH = r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)"
ISO = r"^\s*\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,7})?)?)?\s*$"
_ZONE = r"(?:\s*(Z|[+-]\d{2}:?\d{2}))?"
# Each with a replacement that puts it as `year-month-day|time|AM or PM|offset`.
DATE_FORMS = {
    rf"^\s*(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:(?:T|\s+){_TIME}{_AMPM}{_ZONE})?\s*$": "$1-$2-$3|$4|$5|$6",
    rf"^\s*(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}})(?:\s+{_TIME}{_AMPM}{_ZONE})?\s*$": "$3-$1-$2|$4|$5|$6",
    rf"^\s*{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:\s+{_TIME}{_AMPM})?\s*$": "$3-$1-$2|$4|$5|",
    rf"^\s*(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}})(?:\s+{_TIME}{_AMPM})?\s*$": "$3-$2-$1|$4|$5|",
    rf"^\s*(?i:mon|tue|wed|thu|fri|sat|sun), (\d{{1,2}}) {_MONTH} (\d{{4}}) {_TIME} GMT\s*$": "$3-$2-$1|$4||Z",
    # A year and a month are the first day of that month.
    r"^\s*(\d{4})[-/](\d{1,2})\s*$": "$1-$2-1|||",
    rf"^\s*{_MONTH},?\s+(\d{{4}})\s*$": "$2-$1-1|||",
}
DATE_START = r"^\s*(?:\d{1,4}[-/]\d|\d{1,2}\s+[A-Za-z]{3}|[A-Za-z]{3,9},?\s+\d)"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

CSV_FIELD = r',((?:"[^"]*+(?:""[^"]*+)*+(?:"|$)|[^,"]++)*+)'
CSV_QUOTED = r'"([^"]*+(?:""[^"]*+)*+)(?:"|$)'


def _starts_visible(x: Column) -> Column:
    """First character is visible ASCII: settles most cells by comparing bytes, without a pattern."""
    return (x >= "!") & (x < "\x7f")


def _plain_number(x: Column) -> Column:
    """Starts with a sign, a point or a digit, ends with a digit and is not hexadecimal.

    Spark's own casts accept nothing of that shape that is not a number here too.
    """
    last = F.right(x, F.lit(1))
    return (x >= "+") & (x < ":") & (last >= "0") & (last <= "9") & ~x.contains("x") & ~x.contains("X")


def is_blank(x: Column) -> Column:
    """NULL, empty or Unicode white space only."""
    return x.isNull() | (~_starts_visible(x) & x.rlike(BLANK))


def blank_to_null(x: Column) -> Column:
    return F.when(_starts_visible(x) | ~x.rlike(BLANK), x)


# --- predicates and conversions -------------------------------------------------------------------------------


def is_guid(x: Column) -> Column:
    return (F.length(x) >= 32) & (x.rlike(GUID_PLAIN) | x.rlike(GUID_X))


def to_guid(x: Column) -> Column:
    """Any accepted form to lower-case 8-4-4-4-12."""
    plain = F.regexp_replace(x, "[^0-9a-fA-F]", "")
    groups = F.regexp_extract_all(F.lower(x), F.lit("0x([0-9a-f]+)"), F.lit(1))
    padded = F.transform(
        groups, lambda g, i: F.lpad(g, F.when(i == 0, 8).when(i <= 2, 4).otherwise(2), F.lit("0"))
    )
    digits = F.when(x.rlike(GUID_PLAIN), plain).when(x.rlike(GUID_X), F.array_join(padded, ""))
    return F.regexp_replace(F.lower(digits), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def is_bool(x: Column) -> Column:
    return (F.length(x) >= 4) & x.rlike(BOOL)


def to_bool(x: Column) -> Column:
    return F.when(x.rlike(BOOL), F.lower(x).contains("true"))


def _integer(x: Column, sql_type: str) -> Column:
    return F.when(_plain_number(x) | x.rlike(LONG), F.trim(x).try_cast(sql_type))


def is_long(x: Column) -> Column:
    return to_long(x).isNotNull()


def to_long(x: Column) -> Column:
    return _integer(x, "bigint")


def to_int(x: Column) -> Column:
    return _integer(x, "int")


def is_double(x: Column) -> Column:
    """The wide number grammar used to infer: also a trailing sign, parentheses and a currency sign."""
    return (_plain_number(x) & x.try_cast("double").isNotNull()) | x.rlike(ANY_NUMBER)


def to_double(x: Column) -> Column:
    """The narrower grammar used to convert; `(5)` and `5-` are not in it."""
    special = F.lower(x)
    other = F.when(x.rlike(FLOAT), F.translate(x, ",", "").try_cast("double")).when(
        x.rlike(SPECIAL_NUMBER),
        F.when(special.contains("nan"), F.lit(float("nan")))
        .when(special.contains("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf"))),
    )
    return F.coalesce(F.when(_plain_number(x), x.try_cast("double")), other)


def to_float(x: Column) -> Column:
    return to_double(x).cast("float")


def to_decimal(x: Column) -> Column:
    return F.when(x.rlike(FLOAT), F.translate(x, ",", "").try_cast("decimal(18,4)"))


def _stamp(form: Column) -> Column:
    """Zone-less timestamp from `year-month-day|time|AM or PM|offset`, an instant shown in the session's time zone."""
    parts = F.split(form, r"\|")
    date, time, half, zone = (F.get(parts, F.lit(i)) for i in range(4))
    month = F.split_part(date, F.lit("-"), F.lit(2))
    number = F.when(month.rlike("^[0-9]"), month).otherwise(
        ((F.instr(F.lit(MONTHS), F.lower(month)) + 2) / 3).cast("int").cast("string")
    )
    day = F.concat_ws(
        "-", F.split_part(date, F.lit("-"), F.lit(1)), number, F.split_part(date, F.lit("-"), F.lit(3))
    )
    at = F.when(time == "", day).otherwise(F.concat_ws(" ", day, time))
    local = at.try_cast("timestamp_ntz")
    hour = F.substring_index(time, ":", 1).try_cast("int")
    noon = F.expr("INTERVAL 12 HOURS")
    offset = F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    return (
        F.when((half != "") & (hour > 12), None)
        .when((F.lower(half) == "pm") & (hour < 12), local + noon)
        .when((F.lower(half) == "am") & (hour == 12), local - noon)
        .when(zone != "", F.concat(at, offset).try_cast("timestamp").cast("timestamp_ntz"))
        .otherwise(local)
    )


def to_datetime(x: Column) -> Column:
    """Date and date-time texts of a closed list of forms.

    Year first (`-` or `/`), month first, month names and the HTTP date, each with an optional time; numeric forms may
    carry an offset. A year and a month alone are the first day of the month. Time-only and day-month-only texts are left out: they depend on today's date.
    """
    form = F.coalesce(
        *[F.when(x.rlike(pattern), F.regexp_replace(x, pattern, to)) for pattern, to in DATE_FORMS.items()]
    )
    # The lambda binds the rewritten text once; it runs only for dates that are not in plain ISO form.
    other = F.get(F.transform(F.array(form), _stamp), F.lit(0))
    return F.when(x.rlike(ISO), F.trim(x).try_cast("timestamp_ntz")).when(x.rlike(DATE_START), other)


def is_datetime(x: Column) -> Column:
    return to_datetime(x).isNotNull()


_CONVERT = {
    LogicalType.UUID: to_guid,
    LogicalType.BOOL: to_bool,
    LogicalType.LONG: to_long,
    LogicalType.DOUBLE: to_double,
    LogicalType.DATETIME: to_datetime,
    LogicalType.STRING: lambda x: x,
    LogicalType.INT: to_int,
    LogicalType.FLOAT: to_float,
    LogicalType.DECIMAL: to_decimal,
}


def convert(x: Column, logical: LogicalType) -> Column:
    """Text to a logical type, NULL where it does not convert."""
    return _CONVERT[logical](x)


# --- rendering ------------------------------------------------------------------------------------------------


def render_number(x: Column) -> Column:
    """Shortest round-trip text: `20` not `20.0`, `1E+15` and `1E-05` outside [1E-4, 1E+15)."""
    text = x.cast("string")
    size = F.abs(x)
    plain = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    widened = F.regexp_replace(x.try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(power < 0, F.lit("E-")).otherwise(F.lit("E+")),
        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(power).cast("string"),
    )
    return (
        F.when(~text.contains("E"), plain)
        .when((size >= 1e-4) & (size < 1e15), widened)
        .otherwise(scientific)
    )


def render(x: Column, logical: LogicalType) -> Column:
    """Value to export text; NULL stays NULL."""
    if logical is LogicalType.DATETIME:
        # To the second: the fraction, if any, follows the first 19 characters.
        return F.substring(x.cast("string"), 1, 19)
    if logical in (LogicalType.DOUBLE, LogicalType.FLOAT):
        return render_number(x)
    if logical is LogicalType.BOOL:
        return F.initcap(x.cast("string"))
    return x.cast("string")


# --- CSV ------------------------------------------------------------------------------------------------------


def csv_split(line: Column) -> Column:
    """Cells of one physical line, still quoted; a quote toggles quoting anywhere in a cell."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CSV_FIELD), F.lit(1))
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ","))


def csv_unquote(cell: Column) -> Column:
    """Text of a cell that `csv_split` gave; NULL for a missing one."""
    bare = F.replace(F.regexp_replace(cell, CSV_QUOTED, "$1"), F.lit('""'), F.lit('"'))
    return F.when(cell.contains('"'), bare).otherwise(cell)


def csv_escape(text: Column, multiline: bool = False) -> Column:
    """Quote a cell only for a comma or a quote; a line break alone is left bare unless cells may have several lines."""
    wrapped = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    special = text.contains(",") | text.contains('"')
    if multiline:
        special = special | text.contains("\n") | text.contains("\r")
    return F.when(special, wrapped).otherwise(F.coalesce(text, F.lit("")))


# --- XML names ------------------------------------------------------------------------------------------------


def xml_name(name: str) -> str:
    """Column name to an element name of ASCII letters, digits and underscores."""
    if not name.strip():
        return "UnknownColumn"
    kept = re.sub(r"[^a-zA-Z0-9_]", "", name)
    if not kept:
        return "Column"
    return "_" + kept if kept[0].isdigit() else kept
