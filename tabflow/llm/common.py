"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.runtime import col, discard, scratch_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back: later jobs start from files, not from lineage."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.__dict__[_FOLDER] = path
    for folders in _open:
        folders.append(path)
    return found


#: Under this name a settled frame knows its folder; lists of the folders settled within `passing`.
_FOLDER, _open = "_tabflow_folder", []


def drop_settled(*frames: DataFrame) -> None:
    """Delete the folders of settled frames that nothing reads any more."""
    for df in frames:
        if path := df.__dict__.pop(_FOLDER, None):
            discard(df.sparkSession, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what was settled within, but for the frames that are put into the list."""
    folders, kept = [], []
    _open.append(folders)
    try:
        yield kept
    finally:
        _open.remove(folders)
        stays = {df.__dict__.get(_FOLDER) for df in kept}
        for path in folders:
            if path not in stays:
                discard(spark, path)


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """All columns as one struct `row`, so that names of extra columns cannot clash with ours."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), *extra)


def content_key(*cols: Column) -> list[Column]:
    """A 128-bit key of some values as two longs; nulls have a key, too, and equal values have equal keys."""
    return [F.xxhash64(F.lit(7), *cols).alias("key_a"), F.xxhash64(F.lit(11), *cols).alias("key_b")]


def kept_by_worker(key: Hashable, make: Callable[[], object]):
    """An object that a Python worker makes once and keeps from task to task.

    The package travels to the workers by value, so that its own module variables start anew with every task.
    """
    store = sys.modules.setdefault("tabflow_worker", types.ModuleType("tabflow_worker")).__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]
