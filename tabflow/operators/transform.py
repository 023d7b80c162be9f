"""Raw text rows to typed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions import cells
from tabflow.runtime import LATE, ORD, col, discard
from tabflow.types import (
    LogicalType,
    check_distinct_names,
    ensure_key,
    field,
    find_key,
)

#: The whole row of a format whose rows list their own columns.
ROW = "__row_map"
# Columns the engine adds to a frame on its way; no input column may take these names.
RESERVED = (ORD, LATE, ROW, "_load", "__stored")


@dataclass
class Raw:
    """A file as read: text columns and the file order, not yet computed.

    A cell is NULL where its row does not have the column at all and `''` where it has it blank; only `partial` formats
    have such absent cells. `LATE`, where present, lists the names (JSON) or values (XML) a row has beyond `columns`.
    """

    df: DataFrame
    columns: list[str]
    partial: bool = False
    #: Folders that hold the rows until they are loaded.
    staging: tuple[str, ...] = ()

    def __post_init__(self):
        check_distinct_names(self.columns)
        taken = [c for c in self.columns if c in RESERVED]
        if taken:
            raise ValueError(f"column names reserved by the engine: {taken}")

    def renamed(self, names: dict[str, str]) -> Raw:
        kept = [c for c in (LATE, ROW, ORD) if c in self.df.columns]
        df = self.df.select(*[col(c).alias(names[c]) for c in self.columns], *kept)
        return Raw(df, [names[c] for c in self.columns], self.partial, self.staging)

    def with_columns(self, names: list[str]) -> Raw:
        """With more columns, which rows have among their late ones; a column that none has is absent everywhere."""
        known = {c.lower() for c in self.columns}
        new = [n for n in names if n.lower() not in known]
        if not new or ROW not in self.df.columns:
            return self
        cells_ = [F.when(F.map_contains_key(ROW, F.lit(n)), F.coalesce(F.try_element_at(ROW, F.lit(n)), F.lit(""))).alias(n) for n in new]
        left = F.array_except(col(LATE), F.array(*[F.lit(n) for n in new])).alias(LATE)
        kept = [col(c) for c in self.columns]
        return Raw(self.df.select(*kept, *cells_, left, ROW, ORD), self.columns + new, self.partial, self.staging)

    def discard(self) -> None:
        """Give up the rows: their staged files are deleted."""
        for path in self.staging:
            discard(self.df.sparkSession, path)

    @property
    def late(self) -> Column | None:
        return col(LATE) if LATE in self.df.columns else None


def _bad_cell(name: str, logical: LogicalType, x: Column) -> Column:
    message = F.concat(F.lit(f"column {name!r}: not a valid {logical.value}: "), x)
    return F.raise_error(message).cast(logical.spark)


def typed_cell(name: str, logical: LogicalType, strict: bool = True) -> Column:
    """Blank to NULL, else the converted value; text that does not convert aborts the job."""
    x = col(name)
    if logical is LogicalType.STRING:
        return cells.blank_to_null(x)
    value = cells.convert(x, logical)
    if strict:
        value = F.coalesce(value, _bad_cell(name, logical, x))
    return F.when(~cells.is_blank(x), value)


def late_keys(raw: Raw) -> DataFrame:
    """Each late name with the number of rows that carry it."""
    late = F.lit(None).cast("array<string>") if raw.late is None else raw.late
    return raw.df.select(F.explode(late).alias("late_key")).groupBy("late_key").agg(F.count("*").alias("n_rows"))


def late_names(raw: Raw) -> list[str]:
    """The late names themselves: one pass over what the rows list, one row per name to the driver."""
    if raw.late is None:
        return []
    return sorted(r["late_key"] for r in late_keys(raw).select("late_key").collect())


def _key_cell(name: str, logical: LogicalType, stored: bool) -> Column:
    """A row without the key column gets a random UUID; a blank key stays NULL and is refused later.

    `stored` tells whether the file has the column at all.
    """
    if logical in (LogicalType.UUID, LogicalType.STRING):
        fresh = F.expr("uuid()")
    else:
        fresh = F.raise_error(
            F.lit(f"a row has no {name} and a random UUID does not fit a {logical.value} key")
        ).cast(logical.spark)
    if not stored:
        return fresh
    return F.when(col(name).isNull(), fresh).otherwise(typed_cell(name, logical))


def transform(raw: Raw, types: dict[str, LogicalType], boxed: bool = False) -> DataFrame:
    """Typed rows, key and order column included.

    Rows without any key column get UUID keys; these must be written out before the rows are used twice, since a
    recomputed task draws new ones. With `boxed`, each non-key cell is a one-field struct, NULL where the row lacks the
    column: that keeps an explicit NULL apart from an absent cell, which a partial update needs.
    """
    types = ensure_key(types)
    key = find_key(types)
    out = []
    for name, logical in types.items():
        meta = field(name, logical).metadata
        if name == key:
            out.append(_key_cell(name, logical, name in raw.columns).alias(name, metadata=meta))
        elif boxed:
            value = F.when(col(name).isNotNull(), F.struct(typed_cell(name, logical).alias("v")))
            out.append(value.alias(name))
        else:
            out.append(typed_cell(name, logical).alias(name, metadata=meta))
    return _refuse_late(raw).select(*out, ORD)


def _refuse_late(raw: Raw) -> DataFrame:
    """Abort when a row has columns beyond the schema."""
    if raw.late is None:
        return raw.df
    names = F.concat(F.lit("columns missing from the first row: "), F.concat_ws(", ", raw.late))
    return raw.df.filter(F.when(F.size(raw.late) > 0, F.raise_error(names).cast("boolean")).otherwise(True))


def struct_of(types: dict[str, LogicalType]) -> T.StructType:
    return T.StructType([field(n, t) for n, t in types.items()])
