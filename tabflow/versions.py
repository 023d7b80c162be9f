"""Versions of a keyed table: what its view shows, and how the next version is published.

The view's text names the loads that count. A version is published by creating a view of its own, which only one load can
do; then the table's view is replaced by the same text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from tabflow.runtime import ident

LOAD = "_load"
ROWS_SUFFIX = "__rows"
_PROPERTY = "tabflow."


class ConcurrentLoadError(RuntimeError):
    """Another load changed the table meanwhile."""


@dataclass(frozen=True)
class State:
    """What the view shows: live loads, those of them that wrote keys of older ones again, streams' last batches."""

    key: str
    buckets: int
    columns: tuple[str, ...]
    version: int = 0
    loads: tuple[int, ...] = ()
    again: tuple[int, ...] = ()
    streams: tuple[tuple[str, int], ...] = ()

    def properties(self) -> dict[str, str]:
        """One property per load, so that none grows with the number of loads."""
        out = {"key": self.key, "buckets": str(self.buckets), "version": str(self.version)}
        out |= {f"load.{x}": "again" if x in self.again else "new" for x in self.loads}
        return out | {f"stream.{name}": str(batch) for name, batch in self.streams}

    @classmethod
    def of(cls, spark: SparkSession, view: str) -> State:
        rows = spark.sql(f"SHOW TBLPROPERTIES {quoted(view)}").collect()
        given = {r["key"].removeprefix(_PROPERTY): r["value"] for r in rows if r["key"].startswith(_PROPERTY)}
        if "key" not in given:
            raise ValueError(f"{view} is not a table of this engine")
        under = lambda kind: {k.removeprefix(kind): v for k, v in given.items() if k.startswith(kind)}
        loads = {int(k): v for k, v in under("load.").items()}
        again = tuple(sorted(k for k, v in loads.items() if v == "again"))
        streams = tuple(sorted((k, int(v)) for k, v in under("stream.").items()))
        columns = tuple(spark.table(view).columns)
        return cls(given["key"], int(given["buckets"]), columns, int(given["version"]), tuple(sorted(loads)), again, streams)


def quoted(name: str) -> str:
    return ".".join(ident(part) for part in name.split("."))


def store_of(name: str) -> str:
    return name + ROWS_SUFFIX


def _version_view(name: str, version: int) -> str:
    return f"{name}__v{version}"


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def state(spark: SparkSession, name: str) -> State:
    """The table's last version; one that was published but not shown, as its load died in between, is shown now."""
    shown = now = State.of(spark, name)
    while exists(spark, _version_view(name, now.version + 1)):
        now = State.of(spark, _version_view(name, now.version + 1))
    if now != shown:
        show(spark, name, now)
    return now


def view_sql(name: str, now: State) -> str:
    store, key = quoted(store_of(name)), ident(now.key)
    among = lambda loads: ", ".join(f"{x}L" for x in loads) or "NULL"
    out = f"SELECT {', '.join('__a.' + ident(c) for c in now.columns)} FROM {store} __a WHERE __a.{LOAD} IN ({among(now.loads)})"
    if now.again:
        newer = f"__b.{LOAD} IN ({among(now.again)}) AND __b.{key} = __a.{key} AND __b.{LOAD} > __a.{LOAD}"
        out += f" AND NOT EXISTS (SELECT 1 FROM {store} __b WHERE {newer})"
    return out


def create_view(spark: SparkSession, verb: str, view: str, name: str, now: State) -> None:
    listed = ", ".join(f"'{_PROPERTY}{k}' = '{_escaped(v)}'" for k, v in now.properties().items())
    spark.sql(f"{verb} {quoted(view)} TBLPROPERTIES ({listed}) AS {view_sql(name, now)}")


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def show(spark: SparkSession, name: str, now: State) -> None:
    create_view(spark, "CREATE OR REPLACE VIEW", name, name, now)


def publish(spark: SparkSession, name: str, before: State, after: State) -> None:
    after = replace(after, version=before.version + 1)
    view = _version_view(name, after.version)
    try:
        create_view(spark, "CREATE VIEW", view, name, after)
    except AnalysisException as e:
        if "ALREADY_EXISTS" in (e.getCondition() or ""):
            raise ConcurrentLoadError(f"{name} changed during the load") from None
        raise
    if State.of(spark, name).version >= after.version:  # others went on, and have dropped the view of this version
        spark.sql(f"DROP VIEW {quoted(view)}")
        raise ConcurrentLoadError(f"{name} changed during the load")
    show(spark, name, after)
    spark.sql(f"DROP VIEW IF EXISTS {quoted(_version_view(name, before.version))}")
