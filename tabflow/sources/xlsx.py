"""XLSX reader for a workbook or a folder of workbooks, one task per workbook."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabflow.functions import cells
from tabflow.functions.workbook import header_and_rows
from tabflow.operators.transform import Raw
from tabflow.runtime import ORD, first_and_largest_file, scratch_dir

_BATCH = 10_000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of each row, up to the last filled one; row 0 of a workbook is its header."""
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns)):
            for some in itertools.batched(enumerate(header_and_rows(content)), _BATCH):
                numbers, rows = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows)), pa.array(numbers, pa.int64()), pa.array(rows, pa.list_(pa.string()))],
                    ["f", "m", "c"],
                )


def read_xlsx(spark: SparkSession, path, extra: list[str] | None = None) -> Raw:
    """Text columns of the first sheet of each workbook; the header is that of the first file by name.

    A workbook holds at most 1,048,576 rows, so one is the unit of work; its rows are handed on as they are unpacked.
    Blank headers become `Column_n`, up to the last filled cell of any row; of columns with the same name the last
    counts, at the place of the first. Every row has every column.
    """
    first_and_largest_file(spark, path)  # there is one
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    # Unpacking a workbook costs far more than reading rows, so it is done once.
    unpacked = scratch_dir(spark, "workbooks")
    files.mapInArrow(_rows, "f string, m bigint, c array<string>").write.parquet(unpacked)
    rows = spark.read.parquet(unpacked)
    # One row per workbook.
    books = rows.groupBy("f").agg(
        F.max(F.size("c")).alias("width"),
        F.max_by("c", F.when(F.col("m") == 0, 1).otherwise(0)).alias("top"),
        (F.max("m") > 0).alias("has_rows"),
    )

    def name(i):
        given = F.get(F.col("top"), i - 1)
        return F.when(cells.is_blank(F.coalesce(given, F.lit(""))), F.concat(F.lit("Column_"), i)).otherwise(given)

    numbers = F.when(F.col("width") > 0, F.sequence(F.lit(1), F.col("width"))).otherwise(F.array().cast("array<int>"))
    books = books.select("f", "has_rows", F.transform(numbers, name).alias("names"))
    names = list(books.agg(F.min_by("names", "f")).first()[0])
    expected = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    # A workbook without rows may have any header.
    other = books.filter(F.col("has_rows") & (expected != F.col("names"))).first()
    if other is not None:
        raise ValueError(f"{other['f']}: header {list(other['names'])} differs from {names}")
    place = {name: i for i, name in enumerate(names)}
    columns = [F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for n, i in place.items()]
    order = F.struct("f", F.lit(0).cast("bigint").alias("b"), "m").alias(ORD)
    return Raw(rows.filter("m > 0").select(*columns, order), list(place), staging=(unpacked,))
