"""Rows that do not fit the types, set aside instead of aborting the load.

Every cell is converted once. A row whose cells all fit goes on as `transform` would give it; one with faults becomes a
reject per fault, with its column, the text and the reason, and the whole row as it stood in the file. Both are written
down in one pass and told apart when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabflow.functions import cells
from tabflow.operators.transform import Raw, typed_cell
from tabflow.runtime import ORD, col, discard, scratch_dir
from tabflow.types import LogicalType, ensure_key, field, find_key

_FAULTS, _CELLS = "__faults", "__cells"
_FAULT = "struct<column:string,text:string,reason:string>"


def _fault(when: Column, name: str, text: Column, reason: str) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("column"), text.cast("string").alias("text"), F.lit(reason).alias("reason")))


def _key(name: str, logical: LogicalType, stored: bool) -> tuple[Column, Column]:
    """The key's cell and its fault: a row without the column gets a random UUID where the type has room for one."""
    textual = logical in (LogicalType.UUID, LogicalType.STRING)
    fresh = F.expr("uuid()") if textual else F.lit(None).cast(logical.spark)
    missing = _fault(F.lit(not textual), name, F.lit(None), "the row has no key")
    if not stored:
        return fresh, missing
    absent = col(name).isNull()
    value = typed_cell(name, logical, strict=False)
    blank = _fault(cells.is_blank(col(name)), name, col(name), "the key is blank")
    wrong = _fault(value.isNull(), name, col(name), f"not a valid {logical.value}")
    return F.when(absent, fresh).otherwise(value), F.when(absent, missing).otherwise(F.coalesce(blank, wrong))


def checked(raw: Raw, types: dict[str, LogicalType], boxed: bool = False) -> DataFrame:
    """Typed rows as `transform` gives them, NULL where a cell does not fit, with the list of faults."""
    types = ensure_key(types)
    key = find_key(types)
    out, faults = [], []
    for name, logical in types.items():
        if name == key:
            value, fault = _key(name, logical, name in raw.columns)
        else:
            value = typed_cell(name, logical, strict=False)
            wrong = ~cells.is_blank(col(name)) & value.isNull()
            fault = _fault(wrong, name, col(name), f"not a valid {logical.value}")
            if boxed:
                value = F.when(col(name).isNotNull(), F.struct(value.alias("v")))
        out.append(value.alias(name, metadata=field(name, logical).metadata))
        if name == key or logical is not LogicalType.STRING:
            faults.append(fault)
    found = F.array_compact(F.array(*faults)).cast(f"array<{_FAULT}>")
    if raw.late is not None:
        late = F.transform(raw.late, lambda n: F.struct(n.alias("column"), F.lit(None).cast("string").alias("text"), F.lit("not a column of the table").alias("reason")))
        found = F.concat(found, late.cast(f"array<{_FAULT}>"))
    texts = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in raw.columns]), F.array(*[col(c) for c in raw.columns])), lambda _, v: v.isNotNull())
    # The key is drawn below the list of faults, so that it is drawn once.
    rows = raw.df.select(*out, col(ORD), found.alias(_FAULTS), texts.alias(_CELLS))
    return rows.withColumn(_CELLS, F.when(F.size(_FAULTS) > 0, F.col(_CELLS)))


class Sorted:
    """Good rows and rejects of one pass over a file, in the scratch folder."""

    def __init__(self, raw: Raw, types: dict[str, LogicalType], boxed: bool = False):
        rows = checked(raw, types, boxed)
        self.spark, self.path, counted = raw.df.sparkSession, scratch_dir(raw.df.sparkSession, "sorted"), Observation()
        rows = rows.observe(counted, F.count(F.lit(1)).alias("read"), F.count_if(F.size(_FAULTS) > 0).alias("rejected"))
        rows.write.parquet(self.path)
        self.read, self.rejected = counted.get["read"], counted.get["rejected"]
        self._rows = self.spark.read.schema(rows.schema).parquet(self.path)

    @property
    def good(self) -> DataFrame:
        return self._rows.filter(F.size(_FAULTS) == 0).drop(_FAULTS, _CELLS)

    @property
    def rejects(self) -> DataFrame:
        """(place, cells, column, text, reason): one row per fault."""
        bad = self._rows.filter(F.size(_FAULTS) > 0)
        return bad.select(F.to_json(col(ORD)).alias("place"), F.col(_CELLS).alias("cells"), F.inline(_FAULTS))

    def discard(self) -> None:
        discard(self.spark, self.path)
