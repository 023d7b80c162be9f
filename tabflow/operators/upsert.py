"""Conflict policies as set-based plans: pure functions from a target and a batch to rows.

The batch is collapsed to one row per key before it meets the target. That aggregate combines map-side, so a key that
fills a third of the batch reaches the shuffle as one row per task, and both join sides have unique keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.runtime import ORD, col
from tabflow.types import Policy


#: Marks the changed rows whose key was stored before.
STORED = "__stored"


class KeyConflictError(ValueError):
    """Policy fail met a key that is already stored, or twice in the batch."""


def _others(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c not in (key, ORD)]


def require_key(batch: DataFrame, key: str) -> DataFrame:
    """Abort the job on a NULL key, whatever the policy."""
    k = col(key)
    kind = batch.schema[key].dataType
    meta = batch.schema[key].metadata
    checked = F.coalesce(k, F.raise_error(F.lit(f"row without a value in key column {key!r}")).cast(kind))
    return batch.select(
        *[checked.alias(c, metadata=meta) if c == key else col(c) for c in batch.columns]
    )


def boxed_to_plain(boxed: DataFrame, key: str) -> DataFrame:
    """Drop the absent/NULL distinction."""
    return boxed.select(*[col(c) if c in (key, ORD) else col(c)["v"].alias(c) for c in boxed.columns])


def first_per_key(batch: DataFrame, key: str) -> DataFrame:
    """The earliest row of each key."""
    return _one_per_key(batch, key, F.min_by)


def last_per_key(batch: DataFrame, key: str) -> DataFrame:
    """The latest row of each key."""
    return _one_per_key(batch, key, F.max_by)


def _one_per_key(batch: DataFrame, key: str, pick) -> DataFrame:
    names = _others(batch, key)
    if not names:
        return batch.select(col(key)).distinct()
    row = F.struct(*[col(c) for c in names])
    return batch.groupBy(col(key)).agg(pick(row, col(ORD)).alias("__row")).select(col(key), "__row.*")


def last_present_per_key(boxed: DataFrame, key: str) -> DataFrame:
    """Per key and column the latest cell that was present, still boxed; NULL where none was."""
    names = _others(boxed, key)
    if not names:
        return boxed.select(col(key)).distinct()
    return boxed.groupBy(col(key)).agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), col(ORD))).alias(c) for c in names]
    )


def stored_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Those of the given keys that the target holds.

    The batch's keys are the side that Spark may broadcast, when it knows them to be few; then the target's key column
    is read but not shuffled.
    """
    return target.select(col(key)).join(keys.select(col(key)), key, "left_semi")


def conflicts(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys that policy fail rejects, with the reason: `table`, `batch` or `both`."""
    counted = batch.groupBy(col(key)).agg(F.count("*").alias("n_rows"))
    matched = stored_keys(target, counted, key).withColumn("__stored", F.lit(True))
    joined = counted.join(matched, key, "left")
    repeated = F.col("n_rows") > 1
    clash = (
        F.when(F.col("__stored") & repeated, "both").when(F.col("__stored"), "table").when(repeated, "batch")
    )
    return joined.select(col(key), "n_rows", clash.alias("clash")).filter("clash IS NOT NULL")


def refuse_conflicts(target: DataFrame | None, batch: DataFrame, key: str, shown: int = 20) -> None:
    """Raise if the batch repeats a key or the target holds one of them."""
    repeated = batch.groupBy(col(key)).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    found = [row[0] for row in repeated.take(shown)]
    if target is not None and not found:
        found = [row[0] for row in stored_keys(target, batch, key).take(shown)]
    if found:
        raise KeyConflictError(f"keys already present or repeated (up to {shown} shown): {found}")


def new_rows(target: DataFrame, collapsed: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key is not stored; reads only the target's key column."""
    return collapsed.join(target.select(col(key)), key, "left_anti")


def aligned(batch: DataFrame, target: DataFrame) -> DataFrame:
    """Batch columns in the target's order and types, NULL for those it lacks."""
    have = {f.name: f.dataType for f in batch.schema.fields}

    def cell(f) -> Column:
        if have.get(f.name) == f.dataType:
            return col(f.name)
        return (col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)

    return batch.select(*[cell(f) for f in target.schema.fields])


def _merged_cell(name: str, present: Column, given: Column) -> Column:
    return F.when(present, given).otherwise(F.col("t")[name]).alias(name)


def _sides(target: DataFrame, collapsed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    left = target.select(col(key), F.struct(*[col(c) for c in target.columns]).alias("t"))
    right = collapsed.select(col(key), F.struct(*[col(c) for c in collapsed.columns]).alias("b"))
    return left, right


def _merged_cells(target: DataFrame, collapsed: DataFrame, key: str, boxed: bool) -> list[Column]:
    """The target's columns with the batch's cells over them, from rows of `_sides` joined."""
    given = set(collapsed.columns)
    out = []
    for c in target.columns:
        if c == key:
            out.append(col(key))
        elif c not in given:
            out.append(F.col("t")[c].alias(c))
        elif boxed:
            out.append(_merged_cell(c, F.col("b")[c].isNotNull(), F.col("b")[c]["v"]))
        else:
            out.append(_merged_cell(c, F.col("b").isNotNull(), F.col("b")[c]))
    return out


def _added(target: DataFrame, collapsed: DataFrame, key: str, boxed: bool) -> DataFrame:
    """Batch rows of new keys, in the target's form."""
    matched = target.select(col(key)).join(collapsed.select(col(key)), key, "left_semi")
    added = collapsed.join(matched, key, "left_anti")
    return aligned(boxed_to_plain(added, key) if boxed else added, target)


def merge(target: DataFrame, collapsed: DataFrame, key: str, boxed: bool) -> DataFrame:
    """Target rows with the batch's cells written over them, plus the rows of new keys.

    A left join of the target with the batch, and the batch without the target's keys. Keys are unique on both sides.
    Which side is broadcast or shuffled is left to Spark, which knows the sizes: a small batch is broadcast to both
    joins, so that the target is not shuffled.
    """
    left, right = _sides(target, collapsed, key)
    updated = left.join(right, key, "left").select(*_merged_cells(target, collapsed, key, boxed))
    return updated.unionByName(_added(target, collapsed, key, boxed))


def changes(target: DataFrame, collapsed: DataFrame, key: str, boxed: bool) -> DataFrame:
    """The rows of `merge` that the target does not hold as they are: those of the batch's keys, with `STORED`.

    A small batch is broadcast; for a large one a target that is bucketed by the key is not shuffled.
    """
    left, right = _sides(target, collapsed, key)
    updated = left.join(right, key).select(*_merged_cells(target, collapsed, key, boxed), F.lit(True).alias(STORED))
    return updated.unionByName(_added(target, collapsed, key, boxed).withColumn(STORED, F.lit(False)))


def apply_policy(
    target: DataFrame,
    batch: DataFrame,
    key: str,
    policy: Policy | str,
    boxed: bool = False,
) -> DataFrame:
    """The table after loading the batch; the batch carries `ORD`, and boxed cells if `boxed`.

    Under policy fail this runs the conflict check at once and raises; otherwise the result is lazy.
    """
    policy = Policy.of(policy)
    batch = require_key(batch, key)
    if policy is Policy.UPDATE:
        collapsed = last_present_per_key(batch, key) if boxed else last_per_key(batch, key)
        return merge(target, collapsed, key, boxed)
    plain = boxed_to_plain(batch, key) if boxed else batch
    if policy is Policy.FAIL:
        refuse_conflicts(target, plain, key)
        added = plain.drop(ORD)
    else:
        added = new_rows(target, first_per_key(plain, key), key)
    return target.unionByName(aligned(added, target))
