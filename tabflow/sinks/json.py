"""JSON writer: a folder of files, each an array of objects with one object per line."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions import cells
from tabflow.runtime import col
from tabflow.sinks.framed import write_framed
from tabflow.types import LogicalType, logical_type


def _quoted(text: Column) -> Column:
    """JSON string literal; only text that needs escapes goes through the JSON writer."""
    listed = F.to_json(F.array(text))
    escaped = F.substring(listed, 2, F.length(listed) - 2)
    plain = ~text.rlike(r'["\\\x00-\x1f\x7f]')
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(escaped)


def _value(x: Column, logical: LogicalType) -> Column:
    if logical in (LogicalType.DOUBLE, LogicalType.FLOAT):
        text = cells.render_number(x)
        finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
        return F.when(finite, text).otherwise(_quoted(text))
    if logical is LogicalType.DATETIME:
        whole = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.regexp_replace(F.date_format(x, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(F.lit('"'), whole, fraction, F.lit('"'))
    if logical in (LogicalType.BOOL, LogicalType.LONG, LogicalType.INT, LogicalType.DECIMAL):
        return x.cast("string")
    return _quoted(x.cast("string"))


def json_object(df: DataFrame) -> Column:
    """One object per row: numbers and booleans native, NULLs kept, datetimes in ISO form."""
    members = [
        F.concat(
            F.lit(json.dumps(f.name, ensure_ascii=False) + ":"),
            F.coalesce(_value(col(f.name), logical_type(f)), F.lit("null")),
        )
        for f in df.schema.fields
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def write_objects(objects: DataFrame, path: str) -> None:
    """Write a column of finished objects as arrays."""
    write_framed(objects, path, "[", ",", "]")


def write_json(df: DataFrame, path: str) -> None:
    """Write rows as arrays of objects."""
    write_objects(df.select(json_object(df).alias("value")), path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Write rows as JSON Lines, an object per line."""
    df.select(json_object(df).alias("value")).write.text(path)
