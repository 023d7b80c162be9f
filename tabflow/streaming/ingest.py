"""Streaming ingest: files that arrive in a folder are loaded into a keyed table as they come, each row exactly once.

The file source hands over lines; every micro-batch is one load under the table's conflict policy. The batch's number is
published together with its rows, in one step: a batch that is run again, since the stream died before it could note that it
was done, finds its number there and loads nothing.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabflow import tables
from tabflow.operators.transform import Raw, late_names
from tabflow.plans.pipelines import load_raw
from tabflow.runtime import ORD, ident
from tabflow.sources.csv import cells_of, header_names, line_reader
from tabflow.sources.json_lines import maps_of
from tabflow.sources.rows import raw_of_maps
from tabflow.types import Policy
from tabflow.versions import store_of

#: Lines in the order of their files: the number within a task follows when the batch is there.
_PLACE = ("_metadata.file_path AS f", "_metadata.file_block_start AS b")


def _csv_lines(spark: SparkSession, path: str, header: str, files: int) -> DataFrame:
    lines = line_reader(spark.readStream.option("maxFilesPerTrigger", files), header).csv(path)
    return lines.selectExpr(f"{ident(header)} AS value", *_PLACE)


def _json_lines(spark: SparkSession, path: str, files: int) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files).text(path).selectExpr("value", *_PLACE)


def _ordered(batch: DataFrame) -> DataFrame:
    return batch.select("value", F.struct("f", "b", F.monotonically_increasing_id().alias("m")).alias(ORD))


def ingest_stream(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    policy: Policy | str | None = None,
    header: str | None = None,
    on_error: str = "abort",
    late: str = "abort",
    files_per_batch: int = 1000,
    reports: list | None = None,
    name: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Load all files that are, and with `available_now=False` those that will be, at a path of CSV or JSON Lines.

    table: an existing keyed table; its columns are the schema. checkpoint: the stream's folder, shared by the cluster.
    header: the header line of the CSV files. name: what the table remembers the stream's batches by, the checkpoint
    folder unless given. reports: a list that gets (batch number, load report). Files may appear in any order; within a
    batch rows have the order of their files' names.
    """
    extension = posixpath.splitext(path.rstrip("/*"))[1].lower()  # a folder or a glob over its folders or files
    if extension == ".csv":
        if header is None:
            raise ValueError("a stream of CSV files needs their header line")
        lines = _csv_lines(spark, path, header, files_per_batch)
        names = header_names(spark, header)
        read = lambda batch: cells_of(batch, names)
    elif extension in (".jsonl", ".ndjson"):
        lines = _json_lines(spark, path, files_per_batch)
        read = lambda batch: _json_raw(batch, table, late)
    else:
        raise NotImplementedError(f"streams of format {extension!r} are not supported")
    known_as = name or checkpoint

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if dict(tables.state(session, table).streams).get(known_as, -1) >= number:
            return
        report = load_raw(session, read(_ordered(batch)), table, policy, on_error, late, (known_as, number))
        if late == "merge":
            # This session has not seen the table's new columns: batches run in a session of their own.
            spark.catalog.refreshTable(store_of(table))
        if reports is not None:
            reports.append((number, report))

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _json_raw(batch: DataFrame, table: str, late: str) -> Raw:
    """The batch's objects under the columns of the table, and with `late="merge"` those that come up in it."""
    raw = raw_of_maps(maps_of(batch), list(tables.types_of(batch.sparkSession, table)), None)
    if late == "merge":
        raw = raw.with_columns(late_names(raw))
    return raw
