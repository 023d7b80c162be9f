"""Column type inference over all rows in one map-side-combined aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions import cells
from tabflow.runtime import col
from tabflow.types import LogicalType

# Precedence of the types a column may get; each has one bit in a cell's mask.
CANDIDATES = (
    LogicalType.UUID,
    LogicalType.BOOL,
    LogicalType.LONG,
    LogicalType.DOUBLE,
    LogicalType.DATETIME,
)
BIT = {t: 1 << i for i, t in enumerate(CANDIDATES)}
ALL = sum(BIT.values())

_OTHER_TESTS = {
    LogicalType.BOOL: cells.is_bool,
    LogicalType.UUID: cells.is_guid,
    LogicalType.DATETIME: cells.is_datetime,
}

PROBE_ROWS = 1000


def _masks(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(i, mask) per cell of the i-th column: bits of the alive types the text parses as, NULL for a blank cell.

    The cells are unpivoted first, so the plan holds the tests once however many columns there are. A type that is no
    longer alive in `columns` is not tested.
    """
    entries = [
        F.struct(F.lit(i).alias("i"), F.lit(alive).alias("alive"), col(c).alias("x"))
        for i, (c, alive) in enumerate(columns.items())
    ]
    unpivoted = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    x, alive = F.col("x"), F.col("alive")
    wanted = set().union(*({t for t in CANDIDATES if bits & BIT[t]} for bits in columns.values()))

    def is_alive(*types: LogicalType) -> Column:
        return alive.bitwiseAND(sum(BIT[t] for t in types)) != 0

    def bit(logical: LogicalType, test: Column) -> Column:
        return F.when(is_alive(logical) & test, BIT[logical]).otherwise(0) if logical in wanted else F.lit(0)

    # Text that is a number can besides only be a UUID of 32 digits.
    digits = bit(LogicalType.UUID, (F.length(x) >= 32) & x.rlike(cells.GUID_HEX))
    number = F.lit(BIT[LogicalType.DOUBLE])
    whole = F.lit(BIT[LogicalType.DOUBLE] | BIT[LogicalType.LONG])
    mask = F.when(cells.is_blank(x), F.lit(None).cast("int"))
    if LogicalType.LONG in wanted:
        mask = mask.when(is_alive(LogicalType.LONG) & cells.is_long(x), whole.bitwiseOR(digits))
    if LogicalType.DOUBLE in wanted:
        mask = mask.when(is_alive(LogicalType.DOUBLE) & cells.is_double(x), number.bitwiseOR(digits))
    for logical, test in _OTHER_TESTS.items():
        if logical in wanted:
            mask = mask.when(is_alive(logical) & test(x), BIT[logical])
    return unpivoted.select("i", mask.otherwise(0).alias("mask"))


def column_masks(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(i, mask) per column: the types that all its non-blank cells parse as, among those alive in `columns`.

    The aggregate has one group per column and combines map-side.
    """
    return _masks(df, columns).groupBy("i").agg(F.bit_and("mask").alias("mask"))


def probe(df: DataFrame, columns: list[str], rows: int = PROBE_ROWS) -> dict[str, int]:
    """Types that the first rows to hand do not rule out yet, as bits per column.

    The rows are combined where they are: one row per column comes to the driver.
    """
    alive = dict.fromkeys(columns, ALL)
    for i, mask in column_masks(df.limit(rows), alive).collect():
        if mask is not None:
            alive[columns[i]] &= mask
    return alive


def types_frame(df: DataFrame, columns: list[str], probe_rows: int = PROBE_ROWS) -> DataFrame:
    """(i, column_type) of every text column, to be computed by one scan.

    A short probe first rules out types that a few rows already contradict. One contradiction is final, so the result
    is that of testing all types on all rows, but the full scan only tests what is still open: plain text columns drop
    out of it altogether.
    """
    alive = probe(df, columns, probe_rows) if probe_rows else dict.fromkeys(columns, ALL)
    names = [c for c in columns if alive[c]]
    decided = df.sparkSession.createDataFrame(
        [(i, LogicalType.STRING.value) for i, c in enumerate(columns) if not alive[c]],
        "i int, column_type string",
    )
    if not names:
        return decided
    logical = F.when(F.col("mask").isNull(), LogicalType.STRING.value)
    for t in CANDIDATES:
        logical = logical.when(F.col("mask").bitwiseAND(BIT[t]) != 0, t.value)
    place = F.get(F.array(*[F.lit(columns.index(c)) for c in names]), F.col("i"))
    masks = column_masks(df, {c: alive[c] for c in names})
    return masks.select(
        place.alias("i"), logical.otherwise(LogicalType.STRING.value).alias("column_type")
    ).unionByName(decided)


def infer_types(
    df: DataFrame, columns: list[str], probe_rows: int = PROBE_ROWS
) -> dict[str, LogicalType]:
    """Logical type of every text column; a column without rows is text."""
    if not columns:
        return {}
    types = dict.fromkeys(columns, LogicalType.STRING)
    for i, name in types_frame(df, columns, probe_rows).collect():
        types[columns[i]] = LogicalType(name)
    return types
