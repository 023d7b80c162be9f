"""User-level operations: add a table from a file, import a file into a table, export a table to a file."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabflow import tables
from tabflow.operators.infer import infer_types
from tabflow.operators.quarantine import Sorted
from tabflow.operators.transform import Raw, late_names, transform
from tabflow.sources import formats
from tabflow.tables import LoadReport
from tabflow.types import LogicalType, Policy, find_key

REJECTS_SUFFIX = "__rejects"


def add_table(
    spark: SparkSession,
    path: str,
    name: str,
    policy: Policy | str | None = None,
    buckets: int | None = None,
    **options,
) -> LoadReport:
    """Read a file, infer its types, create the table and load the rows; on any error there is no table.

    options: what the format's reader takes, such as `multiline` for CSV.
    """
    policy = Policy.of(policy)
    raw = formats.read(spark, path, **options)
    try:
        if not raw.df.take(1):
            raise ValueError(f"{path} has no rows")
        types = infer_types(raw.df, raw.columns)
        if buckets is None:
            buckets = tables.buckets_for(tables.input_bytes(spark, path))
        boxed = raw.partial and policy is Policy.UPDATE
        return tables.create_and_load(spark, name, types, transform(raw, types, boxed), policy, boxed, buckets)
    finally:
        raw.discard()


def import_into(
    spark: SparkSession,
    path: str,
    name: str,
    policy: Policy | str | None = None,
    on_error: str = "abort",
    late: str = "abort",
    **options,
) -> LoadReport:
    """Load a file into an existing table, cast to the table's types; all rows or none.

    Columns are matched without regard to case, as Spark does. A cell that does not fit the table's type, a row without
    a key or with a column that the table does not have is an error. With `on_error="quarantine"` such rows go to the
    table `<name>__rejects` instead, and the others are loaded. With `late="merge"` columns that the table does not have
    are added to it as text, wherever in the file they come up first.
    """
    key = tables.state(spark, name).key
    raw = formats.read(spark, path, extra=[c for c in tables.types_of(spark, name) if c != key], **options)
    try:
        if late == "merge":
            raw = raw.with_columns(late_names(raw))
        return load_raw(spark, raw, name, policy, on_error, late)
    finally:
        raw.discard()


def load_raw(
    spark: SparkSession,
    raw: Raw,
    name: str,
    policy: Policy | str | None = None,
    on_error: str = "abort",
    late: str = "abort",
    stream: tuple[str, int] | None = None,
) -> LoadReport:
    """Load rows as read into an existing table; see `import_into`."""
    if on_error not in ("abort", "quarantine") or late not in ("abort", "merge"):
        raise ValueError("on_error is abort or quarantine, late is abort or merge")
    policy = Policy.of(policy)
    table_types = tables.types_of(spark, name)
    key = tables.state(spark, name).key
    stored_name = {c.lower(): c for c in table_types}
    unknown = [c for c in raw.columns if c.lower() not in stored_name]
    if unknown and late == "abort":
        raise ValueError(f"{name} has no columns {unknown}")
    raw = raw.renamed({c: stored_name.get(c.lower(), c) for c in raw.columns})
    types = {c: table_types.get(c, LogicalType.STRING) for c in raw.columns}
    if find_key(types) is None:
        types = {key: table_types[key], **types}
    boxed = raw.partial and policy is Policy.UPDATE
    if on_error == "abort":
        return tables.load(spark, name, transform(raw, types, boxed), policy, boxed, stream)
    split = Sorted(raw, types, boxed)
    try:
        if split.rejected:
            # Before the rows are published: a load that then fails leaves its rejects, which name the attempt.
            attempt = f"{stream[0]}:{stream[1]}" if stream else split.path.rpartition("-")[2]
            rejects = split.rejects.withColumn("attempt", F.lit(attempt))
            rejects.write.mode("append").saveAsTable(name + REJECTS_SUFFIX)
        report = tables.load(spark, name, split.good, policy, boxed, stream)
        return replace(report, read=split.read, rejected=split.rejected)
    finally:
        split.discard()


def export_table(spark: SparkSession, name: str, path: str, **options) -> None:
    """Write a table to a new folder in the format of the path's extension; options go to the format's writer."""
    formats.write(tables.scan(spark, name), path, **options)
