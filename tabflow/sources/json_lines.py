"""JSON Lines: one object per line, split by line like any text; cells keep the text of the line.

Nothing is staged: a line is parsed where it is read, so columns and filters decide what a plan carries on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from tabflow.functions import cells
from tabflow.operators.transform import Raw
from tabflow.runtime import ORD, file_order, first_and_largest_file
from tabflow.sources.json import rows_of
from tabflow.sources.rows import raw_of_maps


def _object(line: str) -> dict[str, str]:
    rows = list(rows_of(f"[{line}]"))
    if len(rows) != 1:
        raise ValueError("malformed JSON: a line is not one object")
    return rows[0]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.map_(pa.string(), pa.string())
    for batch in batches:
        rows = pa.array([list(_object(line).items()) for line in batch.column(0).to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([rows, *batch.columns[1:]], ["row", *batch.schema.names[1:]])


def maps_of(lines: DataFrame) -> DataFrame:
    """(row, order) of (value, order): each line's members as a map, blank lines left out."""
    schema = StructType().add("row", MapType(StringType(), StringType()))
    for f in lines.schema.fields[1:]:
        schema.add(f)
    value = F.regexp_replace("value", "^﻿", "").alias("value")
    return lines.filter(~cells.is_blank(F.col("value"))).select(value, *lines.columns[1:]).mapInArrow(_parse, schema)


def names_of(spark: SparkSession, path) -> list[str]:
    """Names of the first object; empty if there is none."""
    file = first_and_largest_file(spark, path)[0]
    first = spark.read.text(file).filter(~cells.is_blank(F.col("value"))).take(1)
    return list(_object(first[0]["value"].removeprefix("﻿"))) if first else []


def read_json_lines(spark: SparkSession, path, extra: list[str] | None = None) -> Raw:
    """Text columns of JSON Lines files, by the rules of `read_json` for names, cells and later names."""
    lines = spark.read.text(path).select("value", file_order().alias(ORD))
    return raw_of_maps(maps_of(lines), names_of(spark, path), extra)
