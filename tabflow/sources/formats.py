"""Format by file extension."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession

from tabflow.operators.transform import Raw
from tabflow.runtime import discard, move_file, scratch_dir
from tabflow.sinks.csv import write_csv
from tabflow.sinks.json import write_json, write_json_lines
from tabflow.sinks.xlsx import write_xlsx
from tabflow.sinks.xml import write_xml
from tabflow.sources.csv import read_csv
from tabflow.sources.json import read_json
from tabflow.sources.json_lines import read_json_lines
from tabflow.sources.xlsx import read_xlsx
from tabflow.sources.xml import read_xml

HANDLERS = {
    ".csv": (read_csv, write_csv),
    ".json": (read_json, write_json),
    ".jsonl": (read_json_lines, write_json_lines),
    ".ndjson": (read_json_lines, write_json_lines),
    ".xml": (read_xml, write_xml),
    ".xlsx": (read_xlsx, write_xlsx),
}


def handlers(path: str):
    """Reader and writer for a path: a file, a folder with a format's extension, or a glob ending in one."""
    extension = posixpath.splitext(path.rstrip("/"))[1].lower()
    try:
        return HANDLERS[extension]
    except KeyError:
        raise NotImplementedError(f"format {extension!r} is not supported") from None


def read(spark: SparkSession, path: str, extra: list[str] | None = None, **options) -> Raw:
    return handlers(path)[0](spark, path, extra, **options)


def write(df: DataFrame, path: str, single_file: bool = False, **options) -> None:
    """Write rows as a new folder of part files, or with `single_file` as one file.

    One file is written by one task, so it is for tables that a task can write; the folder is not bound by that.
    """
    writer = handlers(path)[1]
    if not single_file:
        return writer(df, path, **options)
    spark = df.sparkSession
    folder = scratch_dir(spark, "export")
    try:
        writer(df.coalesce(1), folder, **options)
        parts = spark.read.format("binaryFile").load(folder).filter("length > 0").select("path").collect()
        # A table without rows gives an empty CSV file.
        move_file(spark, parts[0]["path"] if parts else None, path)
    finally:
        discard(spark, folder)
