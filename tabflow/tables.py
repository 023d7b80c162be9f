"""Keyed tables: a Spark table of loads, bucketed by the key, and a view that names the loads that count.

The rows lie in one Parquet table, partitioned by load and bucketed by key, so that joins on the key do not shuffle them.
A load writes one new partition, which nothing reads yet, and publishes it: it creates the view of the table's next
version, which only one load can do, and replaces the table's own view by the same text. Readers see all of a load or none
of it. Policies fail and ignore write the rows they add. Policy update writes the rows it adds and those it changes;
of a key that an update has written again, the view shows the newest row. `compact` brings all loads together again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabflow.operators import upsert
from tabflow.operators.transform import struct_of
from tabflow.runtime import ORD, col, discard, ident, scratch_dir
from tabflow.types import LogicalType, Policy, ensure_key, find_key, logical_type
from tabflow.versions import LOAD, ROWS_SUFFIX, ConcurrentLoadError, State, create_view, exists, publish, quoted, state, store_of, view_sql

__all__ = ["ConcurrentLoadError", "exists", "state"]

#: Bytes of input per bucket of a new table, rows of its first load per bucket, and the most buckets.
BUCKET_BYTES, BUCKET_ROWS, MAX_BUCKETS = 1 << 27, 1 << 20, 1 << 16


class TableExistsError(ValueError):
    """A table of that name is already there."""


@dataclass(frozen=True)
class LoadReport:
    """Rows of a batch by what became of them.

    ignored: policy ignore left them out for a stored or an earlier row; combined: under policy update, rows that went
    into another row of their key; rejected: set aside as they do not fit the types.
    """

    policy: str
    read: int = 0
    inserted: int = 0
    updated: int = 0
    ignored: int = 0
    combined: int = 0
    rejected: int = 0


@dataclass
class _Written:
    after: State
    report: LoadReport = field(default_factory=lambda: LoadReport("fail"))


def types_of(spark: SparkSession, name: str) -> dict[str, LogicalType]:
    """Column names and logical types of a table."""
    return {f.name: logical_type(f) for f in spark.table(name).schema.fields}


def buckets_for(n_bytes: int) -> int:
    """Number of buckets for a table expected to start at this size."""
    return max(1, min(MAX_BUCKETS, n_bytes // BUCKET_BYTES))


def input_bytes(spark: SparkSession, path) -> int:
    """Total size of the files at a path; their content is not read."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


# --- creating ----------------------------------------------------------------------------------


def _refuse_existing(spark: SparkSession, name: str) -> None:
    if exists(spark, name) or exists(spark, store_of(name)):
        raise TableExistsError(f"table {name} already exists")


def _create_store(spark: SparkSession, name: str, types: dict[str, LogicalType], buckets: int) -> State:
    _refuse_existing(spark, name)
    types = ensure_key(types)
    key = find_key(types)
    empty = spark.createDataFrame([], struct_of(types).add(LOAD, "long"))
    empty.write.partitionBy(LOAD).bucketBy(buckets, key).saveAsTable(store_of(name))
    return State(key, buckets, tuple(types))


def create_table(spark: SparkSession, name: str, types: dict[str, LogicalType], buckets: int = 1) -> None:
    """An empty table with the given columns; a UUID key column is put in front if they have none."""
    create_view(spark, "CREATE VIEW", name, name, _create_store(spark, name, types, buckets))


def create_and_load(
    spark: SparkSession,
    name: str,
    types: dict[str, LogicalType],
    batch: DataFrame,
    policy: Policy | str,
    boxed: bool = False,
    buckets: int = 1,
) -> LoadReport:
    """Create a table with its first rows; after an error there is no table.

    buckets: at least; there is one for every `BUCKET_ROWS` rows, as a task writes, or reads, a bucket of the table.
    """
    _refuse_existing(spark, name)
    buckets = max(buckets, min(MAX_BUCKETS, -(-batch.count() // BUCKET_ROWS)))
    before = _create_store(spark, name, types, buckets)
    try:
        written = _write(spark, name, before, batch, Policy.of(policy), boxed)
        create_view(spark, "CREATE VIEW", name, name, written.after)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(store_of(name))}")
        raise
    return written.report


def load(
    spark: SparkSession,
    name: str,
    batch: DataFrame,
    policy: Policy | str,
    boxed: bool = False,
    stream: tuple[str, int] | None = None,
) -> LoadReport:
    """Load a typed batch, with its order column, under a conflict policy; all of it or nothing.

    Text columns that the table lacks are added to it; older rows have NULL there. `stream` names a stream and the
    number of its batch: the number is published with the rows, and a batch that was published is not loaded again.
    """
    before = state(spark, name)
    if stream and dict(before.streams).get(stream[0], -1) >= stream[1]:
        return LoadReport(Policy.of(policy).value)
    added = [c for c in batch.columns if c != ORD and c not in before.columns]
    if added:
        _add_columns(spark, name, added)
        before = replace(before, columns=before.columns + tuple(added))
    written = _write(spark, name, before, batch, Policy.of(policy), boxed)
    after = written.after
    if stream:
        after = replace(after, streams=tuple(sorted((dict(after.streams) | {stream[0]: stream[1]}).items())))
    publish(spark, name, before, after)
    return written.report


def _add_columns(spark: SparkSession, name: str, added: list[str]) -> None:
    """Text columns for the store; the view shows them when a load that has them is published."""
    there = spark.table(store_of(name)).columns
    missing = [f"{ident(c)} STRING" for c in added if c not in there]
    if missing:
        spark.sql(f"ALTER TABLE {quoted(store_of(name))} ADD COLUMNS ({', '.join(missing)})")


def compact(spark: SparkSession, name: str) -> None:
    """Rewrite all live rows as one load: for when many loads, or large updates, make reading slow."""
    before = state(spark, name)
    if not before.loads:
        return
    number = _next_load(before)
    _write_load(spark.table(name), name, before, number)
    publish(spark, name, before, replace(before, loads=(number,), again=()))


def drop_superseded(spark: SparkSession, name: str, older_than_s: float = 0) -> None:
    """Delete loads that the view no longer shows, also failed ones; for when no old reader is left.

    Loads are numbered by the time they began. Only those that began before the newest live one, and so long ago as
    asked for, are looked at: a load that is still running and can still be published began after it.
    """
    now = state(spark, name)
    limit = min(max(now.loads, default=0), time.time_ns() // 1000 - int(older_than_s * 1e6))
    partitions = spark.sql(f"SHOW PARTITIONS {quoted(store_of(name))}")
    numbers = partitions.select(F.split("partition", "=")[1].cast("long").alias("n")).filter(F.col("n") < limit)
    dead = [f"PARTITION ({LOAD} = {r['n']})" for r in numbers.collect() if r["n"] not in now.loads]
    if dead:
        spark.sql(f"ALTER TABLE {quoted(store_of(name))} DROP IF EXISTS {', '.join(dead)}")


# --- writing a load -------------------------------------------------------------------------------------------


def _next_load(now: State) -> int:
    """A number above all live loads that no earlier attempt has used."""
    return max(time.time_ns() // 1000, *(x + 1 for x in now.loads), 1)


def _stored(spark: SparkSession, name: str, now: State) -> DataFrame:
    """All rows of live loads; a key that was written again comes more than once."""
    return spark.table(store_of(name)).where(col(LOAD).isin(list(now.loads)))


def _columns(spark: SparkSession, name: str, now: State) -> DataFrame:
    """The table's own columns, for their names and types."""
    return spark.table(store_of(name)).select(*[col(c) for c in now.columns])


def _write_load(rows: DataFrame, name: str, now: State, number: int) -> None:
    """Append rows as a load, one file per bucket."""
    store = rows.sparkSession.table(store_of(name))
    out = upsert.aligned(rows, store.drop(LOAD)).withColumn(LOAD, F.lit(number).cast("bigint"))
    out.repartition(now.buckets, col(now.key)).write.insertInto(store_of(name))


def _counted(**counts: Column):
    """An observation, and a function that takes counts of a frame's rows as they are written."""
    seen = Observation()
    return seen, lambda df: df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()])


def _count(seen: Observation, name: str) -> int:
    """A count of an observation, once its frame is written; a frame that turns out empty is planned away with it."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return 0


def _write(spark: SparkSession, name: str, now: State, batch: DataFrame, policy: Policy, boxed: bool) -> _Written:
    """Write the batch's load, count its rows on the way, and return the state that would show it."""
    number = _next_load(now)
    key_type = _columns(spark, name, now).schema[now.key].dataType
    if batch.schema[now.key].dataType != key_type:
        batch = batch.withColumn(now.key, col(now.key).cast(key_type))
    batch = upsert.require_key(batch, now.key)
    read, reading = _counted(n=F.count(F.lit(1)))
    done, writing = _counted(n=F.count(F.lit(1)), updated=F.count_if(F.col(upsert.STORED)))
    if policy is Policy.FAIL:
        plain = upsert.boxed_to_plain(batch, now.key) if boxed else batch
        upsert.refuse_conflicts(_stored(spark, name, now) if now.loads else None, plain, now.key)
        _write_load(reading(plain).drop(ORD), name, now, number)
        report = LoadReport("fail", _count(read, "n"), _count(read, "n"))
        return _Written(replace(now, loads=(*now.loads, number)), report)
    if policy is Policy.IGNORE:
        plain = upsert.boxed_to_plain(batch, now.key) if boxed else batch
        fresh = upsert.first_per_key(reading(plain), now.key)
        if now.loads:
            fresh = upsert.new_rows(_stored(spark, name, now), fresh, now.key)
        _write_load(writing(fresh.withColumn(upsert.STORED, F.lit(False))).drop(upsert.STORED), name, now, number)
        n, added = _count(read, "n"), _count(done, "n")
        return _Written(replace(now, loads=(*now.loads, number)), LoadReport("ignore", n, added, ignored=n - added))
    collapsed = upsert.last_present_per_key(reading(batch), now.key) if boxed else upsert.last_per_key(reading(batch), now.key)
    # Written out: the changes read it more than once, and random keys must not be drawn again. Its size is then known,
    # too: a small batch is broadcast, and for a large one the stored rows need no shuffle.
    staging = scratch_dir(spark, "staging")
    collapsed.write.parquet(staging)
    try:
        staged = spark.read.schema(collapsed.schema).parquet(staging)
        target = spark.sql(view_sql(name, now))
        _write_load(writing(upsert.changes(target, staged, now.key, boxed)).drop(upsert.STORED), name, now, number)
    finally:
        discard(spark, staging)
    n, kept, updated = _count(read, "n"), _count(done, "n"), _count(done, "updated")
    after = replace(now, loads=(*now.loads, number), again=(*now.again, number) if updated else now.again)
    return _Written(after, LoadReport("update", n, kept - updated, updated, combined=n - kept))


# --- reading --------------------------------------------------------------------------------------------------


def scan(spark: SparkSession, name: str) -> DataFrame:
    """All rows of a table."""
    return spark.table(name)


def preview(spark: SparkSession, name: str, n: int = 1000, ordered: bool = False) -> DataFrame:
    """`n` rows with the table's own types: the first to come to hand, or with `ordered` those of the lowest keys."""
    rows = spark.table(name)
    if ordered:
        rows = rows.orderBy(col(state(spark, name).key))
    return rows.limit(n)


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Names of the user's tables in a database: no views, temporary tables or stores."""
    db = ident(database)
    tables = spark.sql(f"SHOW TABLES IN {db}").filter("NOT isTemporary").select(F.col("tableName").alias("table_name"))
    views = spark.sql(f"SHOW VIEWS IN {db}").filter("NOT isTemporary").select(F.col("viewName").alias("table_name"))
    is_store = F.col("table_name").endswith(ROWS_SUFFIX)
    stores = tables.filter(is_store).select(
        F.substring("table_name", F.lit(1), F.length("table_name") - len(ROWS_SUFFIX)).alias("table_name")
    )
    return views.join(stores, "table_name", "left_semi").unionByName(
        tables.filter(~is_store).join(views, "table_name", "left_anti")
    )
