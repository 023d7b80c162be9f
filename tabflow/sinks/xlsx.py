"""XLSX writer: a folder of workbooks, one or more per task."""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tabflow.functions.cells import render
from tabflow.functions.workbook import MAX_DATA_ROWS, write_workbook
from tabflow.runtime import col, scratch_dir
from tabflow.types import LogicalType, logical_type

# Types that become native cells; all others are written as text.
_NATIVE = (LogicalType.DATETIME, LogicalType.DOUBLE, LogicalType.LONG, LogicalType.BOOL)


def _put(fs, base: str, name: str, content: bytes) -> None:
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(content)


def _writer(folder: str, header: list[str], rows_per_file: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        task = TaskContext.get().partitionId()
        for n in itertools.count():
            first = next(rows, None)
            if first is None:
                return
            # Rows go straight into the compressed sheet; only that is held in memory.
            content, n_rows = write_workbook(header, itertools.chain([first], itertools.islice(rows, rows_per_file - 1)))
            name = f"part-{task:05d}-{n:04d}.xlsx"
            # A repeated attempt writes other files; the manifest says which one counts.
            written = f"{name}.{uuid.uuid4().hex}"
            _put(fs, base, written, content)
            yield pa.RecordBatch.from_pydict(
                {"file": [name], "written": [written], "n_rows": pa.array([n_rows], pa.int64())}
            )

    return write


def _uri(spark: SparkSession, path: str) -> str:
    """Path with a file system that the workbook tasks can open; one without is on Spark's default file system."""
    if "://" in path:
        scheme, rest = path.split("://", 1)
        return ("s3" if scheme in ("s3a", "s3n") else scheme) + "://" + rest
    if path.startswith("file:"):
        return "file://" + path.removeprefix("file:")
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    return "file://" + os.path.abspath(path) if default.startswith("file:") else default.rstrip("/") + path


def write_xlsx(df: DataFrame, path: str, rows_per_file: int = MAX_DATA_ROWS) -> DataFrame:
    """Write workbooks of at most `rows_per_file` rows into a new folder and return (file, n_rows) per workbook.

    Tasks write below a hidden folder; when all of them are done, the workbooks of the manifest are moved into place
    and `_SUCCESS` says that the folder is complete. A table without rows gives one workbook with a header.
    """
    if not 0 < rows_per_file <= MAX_DATA_ROWS:
        raise ValueError(f"a sheet holds at most {MAX_DATA_ROWS} data rows")
    spark = df.sparkSession
    folder = _uri(spark, path)
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)  # an unknown scheme is refused here, before any work
    if fs.get_file_info(base).type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(path)
    hidden = f"_parts-{uuid.uuid4().hex}"
    fs.create_dir(f"{base}/{hidden}")
    cells = [
        col(f.name) if logical_type(f) in _NATIVE else render(col(f.name), logical_type(f)).alias(f.name)
        for f in df.schema.fields
    ]
    manifest = scratch_dir(spark, "xlsx-manifest")
    (
        df.select(*cells)
        .mapInArrow(_writer(f"{folder}/{hidden}", df.columns, rows_per_file), "file string, written string, n_rows bigint")
        .write.parquet(manifest)
    )
    listed = spark.read.parquet(manifest)
    any_rows = False
    for workbook in listed.select("file", "written").toLocalIterator():
        fs.move(f"{base}/{hidden}/{workbook['written']}", f"{base}/{workbook['file']}")
        any_rows = True
    if not any_rows:
        _put(fs, base, "part-00000-0000.xlsx", write_workbook(df.columns, [])[0])
        one = [("part-00000-0000.xlsx", "", 0)]
        listed = spark.createDataFrame(one, "file string, written string, n_rows bigint")
    fs.delete_dir(f"{base}/{hidden}")
    _put(fs, base, "_SUCCESS", b"")
    return listed.select("file", "n_rows")
