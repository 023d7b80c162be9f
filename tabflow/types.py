"""Logical column types, their Spark and DBMS counterparts, and the conflict policies."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

KEY = "Id"


class Policy(Enum):
    """What to do with a row whose key is already present."""

    FAIL = "fail"
    IGNORE = "ignore"
    UPDATE = "update"

    @classmethod
    def of(cls, name: "Policy | str | None") -> "Policy":
        """Policy by value, by name in any case, or by the label shown to users; FAIL by default."""
        if isinstance(name, Policy):
            return name
        if name is None:
            return cls.FAIL
        by_label = POLICY_LABELS.get(name)
        if by_label is not None:
            return cls(by_label)
        try:
            return cls(name.strip().lower())
        except ValueError:
            raise ValueError(f"unknown conflict policy {name!r}; use fail, ignore or update") from None


# User-facing policy labels.
POLICY_LABELS = {
    "Исключение": "fail",
    "Обновлять": "update",
    "Игнорировать": "ignore",
}


class LogicalType(Enum):
    """Column types the engine knows; the first six can be inferred from text."""

    UUID = "uuid"
    BOOL = "bool"
    LONG = "long"
    DOUBLE = "double"
    DATETIME = "datetime"
    STRING = "string"
    INT = "int"
    FLOAT = "float"
    DECIMAL = "decimal"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]


_SPARK: dict[LogicalType, T.DataType] = {
    LogicalType.UUID: T.StringType(),
    LogicalType.BOOL: T.BooleanType(),
    LogicalType.LONG: T.LongType(),
    LogicalType.DOUBLE: T.DoubleType(),
    LogicalType.DATETIME: T.TimestampNTZType(),
    LogicalType.STRING: T.StringType(),
    LogicalType.INT: T.IntegerType(),
    LogicalType.FLOAT: T.FloatType(),
    LogicalType.DECIMAL: T.DecimalType(18, 4),
}

# Physical column type per DBMS.
PHYSICAL_TYPES: dict[str, dict[LogicalType, str]] = {
    "sqlite": {
        LogicalType.UUID: "TEXT",
        LogicalType.BOOL: "INTEGER",
        LogicalType.LONG: "INTEGER",
        LogicalType.DOUBLE: "REAL",
        LogicalType.DATETIME: "TEXT",
        LogicalType.STRING: "TEXT",
        LogicalType.INT: "INTEGER",
        LogicalType.FLOAT: "REAL",
        LogicalType.DECIMAL: "REAL",
    },
    "postgres": {
        LogicalType.UUID: "UUID",
        LogicalType.BOOL: "BOOLEAN",
        LogicalType.LONG: "BIGINT",
        LogicalType.DOUBLE: "DOUBLE PRECISION",
        LogicalType.DATETIME: "TIMESTAMP",
        LogicalType.STRING: "TEXT",
        LogicalType.INT: "INTEGER",
        LogicalType.FLOAT: "REAL",
        LogicalType.DECIMAL: "NUMERIC(18,4)",
    },
    "mssql": {
        LogicalType.UUID: "UNIQUEIDENTIFIER",
        LogicalType.BOOL: "BIT",
        LogicalType.LONG: "BIGINT",
        LogicalType.DOUBLE: "FLOAT",
        LogicalType.DATETIME: "DATETIME2",
        LogicalType.STRING: "NVARCHAR(MAX)",
        LogicalType.INT: "INT",
        LogicalType.FLOAT: "REAL",
        LogicalType.DECIMAL: "DECIMAL(18,4)",
    },
}

_METADATA_KEY = "logical_type"


def field(name: str, logical: LogicalType) -> T.StructField:
    """Struct field of a logical type; UUIDs are strings marked in the field metadata."""
    metadata = {_METADATA_KEY: logical.value} if logical is LogicalType.UUID else {}
    return T.StructField(name, logical.spark, True, metadata)


def logical_type(f: T.StructField) -> LogicalType:
    """Logical type of a Spark field; types outside the model count as text."""
    marked = (f.metadata or {}).get(_METADATA_KEY)
    if marked:
        return LogicalType(marked)
    dt = f.dataType
    if isinstance(dt, T.BooleanType):
        return LogicalType.BOOL
    if isinstance(dt, T.LongType):
        return LogicalType.LONG
    if isinstance(dt, T.DoubleType):
        return LogicalType.DOUBLE
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        return LogicalType.DATETIME
    if isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
        return LogicalType.INT
    if isinstance(dt, T.FloatType):
        return LogicalType.FLOAT
    if isinstance(dt, T.DecimalType):
        return LogicalType.DECIMAL
    return LogicalType.STRING


def find_key(columns) -> str | None:
    """The key column: the one called Id in any case."""
    return next((c for c in columns if c.lower() == KEY.lower()), None)


def ensure_key(schema: dict[str, LogicalType]) -> dict[str, LogicalType]:
    """Prepend a UUID key column unless the schema already has one."""
    if find_key(schema) is not None:
        return dict(schema)
    return {KEY: LogicalType.UUID, **schema}


def check_distinct_names(columns) -> None:
    """Names that differ only in case cannot live in one Spark table."""
    seen: dict[str, str] = {}
    for c in columns:
        other = seen.setdefault(c.lower(), c)
        if other != c:
            raise ValueError(f"columns {other!r} and {c!r} differ only in case")
