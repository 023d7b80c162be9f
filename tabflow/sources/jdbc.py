"""Relational databases over JDBC: SQLite, PostgreSQL and SQL Server.

Rows move in parallel between executors and the database; a load goes into a staging table first and from there into
the target by one set-based statement, or two in one transaction. The vendor's JDBC driver must be on the class path.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, SparkSession

from tabflow.functions import cells
from tabflow.operators import upsert
from tabflow.runtime import ORD, col, scratch_dir
from tabflow.types import PHYSICAL_TYPES, LogicalType, Policy, ensure_key, find_key, logical_type

# Names under which a DBMS may be asked for.
DBMS_NAMES = {
    "sqlite": "sqlite",
    "postgres": "postgres",
    "postgresql": "postgres",
    "mssql": "mssql",
    "ms sql server": "mssql",
}
DRIVERS = {
    "sqlite": "org.sqlite.JDBC",
    "postgres": "org.postgresql.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}
# Fixed value: the file of a database without a path.
DEFAULT_SQLITE = "Data Source=etl.db"
# The user tables of each DBMS.
TABLE_LIST_SQL = {
    "sqlite": "SELECT name AS table_name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'",
    "postgres": "SELECT table_name FROM information_schema.tables "
    "WHERE table_schema = 'public' AND table_type = 'BASE TABLE'",
    "mssql": "SELECT TABLE_NAME AS table_name FROM INFORMATION_SCHEMA.TABLES WHERE TABLE_TYPE = 'BASE TABLE'",
}
_SET_SUFFIX = "__set"


@dataclass(frozen=True)
class Connection:
    """Where a database is: its kind, JDBC address and JDBC options."""

    dbms: str
    url: str
    options: dict[str, str] = dc_field(default_factory=dict)

    def quote(self, name: str) -> str:
        if self.dbms == "mssql":
            return "[" + name.replace("]", "]]") + "]"
        return '"' + name.replace('"', '""') + '"'

    def reader_options(self) -> dict[str, str]:
        return {"url": self.url, "driver": DRIVERS[self.dbms], **self.options}


def dbms_key(name: str) -> str:
    try:
        return DBMS_NAMES[name.strip().lower()]
    except KeyError:
        raise NotImplementedError(f"DBMS {name!r} is not supported") from None


def connect(dbms: str, connection_string: str) -> Connection:
    """Connection from a JDBC address or a `key=value;` connection string."""
    kind = dbms_key(dbms)
    if not connection_string or not connection_string.strip():
        raise ValueError("the connection string is empty")
    if connection_string.startswith("jdbc:"):
        return Connection(kind, connection_string, _extras(kind))
    pairs = (part.partition("=") for part in connection_string.split(";") if part.strip())
    given = {k.strip().lower(): v.strip() for k, _, v in pairs}

    def first(*names: str, default: str = "") -> str:
        return next((given[n] for n in names if n in given), default)

    options = _extras(kind)
    user, password = first("username", "user id", "user", "uid"), first("password", "pwd")
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    if kind == "sqlite":
        return Connection(kind, f"jdbc:sqlite:{first('data source', 'filename')}", options)
    database = first("database", "initial catalog")
    if kind == "postgres":
        host = first("host", "server", default="localhost")
        return Connection(kind, f"jdbc:postgresql://{host}:{first('port', default='5432')}/{database}", options)
    url = f"jdbc:sqlserver://{first('server', 'data source').replace(',', ':')};databaseName={database}"
    if first("trusted_connection", "integrated security").lower() in ("true", "yes", "sspi"):
        url += ";integratedSecurity=true"
    if first("trustservercertificate").lower() in ("true", "yes"):
        url += ";trustServerCertificate=true"
    return Connection(kind, url, options)


def _extras(kind: str) -> dict[str, str]:
    # Lets the server convert text to UUID.
    return {"stringtype": "unspecified"} if kind == "postgres" else {}


def connect_by_key(dbms: str, connection_strings: dict[str, str]) -> Connection:
    """Connection from settings with the keys Sqlite, Postgres and MsSql; SQLite has a default."""
    kind = dbms_key(dbms)
    by_kind = {dbms_key(k): v for k, v in connection_strings.items()}
    text = by_kind.get(kind) or (DEFAULT_SQLITE if kind == "sqlite" else "")
    if not text:
        raise ValueError(f"no connection string for {dbms}")
    return connect(kind, text)


# --- reading --------------------------------------------------------------------------------------------------


def table_names(spark: SparkSession, db: Connection) -> DataFrame:
    """User tables of a database."""
    return spark.read.format("jdbc").options(**db.reader_options()).option("query", TABLE_LIST_SQL[db.dbms]).load()


def scan(
    spark: SparkSession,
    db: Connection,
    table: str,
    partition_column: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """All rows of a table.

    With a numeric, date or timestamp `partition_column` the range between its smallest and largest value is read by
    `num_partitions` queries at once; without one, a single task reads the table.
    """
    reader = spark.read.format("jdbc").options(**db.reader_options()).option("fetchsize", 10_000)
    if partition_column:
        c = db.quote(partition_column)
        bounds = (
            spark.read.format("jdbc").options(**db.reader_options())
            .option("query", f"SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM {db.quote(table)}")
            .load().first()
        )
        if bounds[0] is not None:
            reader = (
                # The plain name: Spark looks the column up and quotes it for the database itself.
                reader.option("partitionColumn", partition_column)
                .option("lowerBound", str(bounds[0]))
                .option("upperBound", str(bounds[1]))
                .option("numPartitions", num_partitions or spark.sparkContext.defaultParallelism)
            )
    return reader.option("dbtable", db.quote(table)).load()


# --- statements -----------------------------------------------------------------------------------------------


def create_table_sql(db: Connection, table: str, types: dict[str, LogicalType], keyed: bool = True) -> str:
    """CREATE TABLE with the DBMS's column types and the key as primary key."""
    if keyed:
        types = ensure_key(types)
    key = find_key(types) if keyed else None
    columns = [
        f"{db.quote(c)} {PHYSICAL_TYPES[db.dbms][t]}" + (" PRIMARY KEY" if c == key else "")
        for c, t in types.items()
    ]
    return f"CREATE TABLE {db.quote(table)} ({', '.join(columns)})"


def load_sql(
    db: Connection, table: str, staging: str, columns: list[str], policy: Policy, partial: bool = False
) -> list[str]:
    """Statements that bring a staging table into the target under a policy, to be run in one transaction.

    Staging has one row per key, but a repeated Spark task may have left it twice. With `partial` it also has a 0/1 column per non-key column
    that tells whether the batch had a value for it.
    """
    q = db.quote
    key = find_key(columns)
    others = [c for c in columns if c != key]
    target, source = q(table), q(staging)
    listed = ", ".join(map(q, columns))
    insert = f"INSERT INTO {target} ({listed}) SELECT DISTINCT {listed} FROM {source}"
    if policy is Policy.FAIL:
        return [insert]
    if db.dbms == "mssql":
        return [_merge_sql(db, target, source, columns, policy, partial)]
    if policy is Policy.IGNORE or not others:
        if db.dbms == "sqlite":
            return [f"INSERT OR IGNORE INTO {target} ({listed}) SELECT DISTINCT {listed} FROM {source}"]
        return [f"{insert} ON CONFLICT ({q(key)}) DO NOTHING"]
    if not partial:
        # The WHERE keeps SQLite from reading ON as the start of a join condition.
        assigned = ", ".join(f"{q(c)} = excluded.{q(c)}" for c in others)
        return [f"{insert} WHERE true ON CONFLICT ({q(key)}) DO UPDATE SET {assigned}"]
    assigned = ", ".join(
        f"{q(c)} = CASE WHEN {source}.{q(c + _SET_SUFFIX)} = 1 THEN {source}.{q(c)} ELSE {target}.{q(c)} END"
        for c in others
    )
    same_key = f"{target}.{q(key)} = {source}.{q(key)}"
    return [
        f"UPDATE {target} SET {assigned} FROM {source} WHERE {same_key}",
        f"{insert} WHERE NOT EXISTS (SELECT 1 FROM {target} WHERE {same_key})",
    ]


def _merge_sql(db: Connection, target: str, source: str, columns: list[str], policy: Policy, partial: bool) -> str:
    q = db.quote
    key = find_key(columns)

    def given(c: str) -> str:
        if not partial:
            return f"s.{q(c)}"
        return f"CASE WHEN s.{q(c + _SET_SUFFIX)} = 1 THEN s.{q(c)} ELSE t.{q(c)} END"

    others = [c for c in columns if c != key]
    update = ""
    if policy is Policy.UPDATE and others:
        update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{q(c)} = {given(c)}' for c in others)}"
    return (
        f"MERGE INTO {target} AS t USING (SELECT DISTINCT * FROM {source}) AS s ON t.{q(key)} = s.{q(key)}{update} "
        f"WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, columns))}) "
        f"VALUES ({', '.join(f's.{q(c)}' for c in columns)});"
    )


# --- writing --------------------------------------------------------------------------------------------------


def _stored(db: Connection, name: str, logical: LogicalType) -> Column:
    """Value as the DBMS keeps it; SQLite has neither booleans nor timestamps."""
    if db.dbms == "sqlite" and logical is LogicalType.BOOL:
        return col(name).cast("int").alias(name)
    if db.dbms == "sqlite" and logical is LogicalType.DATETIME:
        return cells.render(col(name), logical).alias(name)
    return col(name)


def staging_rows(db: Connection, batch: DataFrame, policy: Policy, boxed: bool) -> DataFrame:
    """Rows for the staging table: collapsed to one per key unless the policy is fail."""
    key = find_key(batch.columns)
    batch = upsert.require_key(batch, key)
    if policy is Policy.UPDATE and boxed:
        collapsed = upsert.last_present_per_key(batch, key)
        flags = [
            col(c).isNotNull().cast("int").alias(c + _SET_SUFFIX) for c in collapsed.columns if c != key
        ]
        values = [col(key)] + [col(c)["v"].alias(c) for c in collapsed.columns if c != key]
        rows = collapsed.select(*values, *flags)
    else:
        plain = upsert.boxed_to_plain(batch, key) if boxed else batch
        if policy is Policy.FAIL:
            rows = plain.drop(ORD)
        elif policy is Policy.IGNORE:
            rows = upsert.first_per_key(plain, key)
        else:
            rows = upsert.last_per_key(plain, key)
    return rows.select(*[_stored(db, f.name, logical_type(f)) for f in rows.schema.fields])


def _run(spark: SparkSession, db: Connection, statements: list[str]) -> None:
    """Run statements on the database in one transaction, from the driver."""
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(DRIVERS[db.dbms])
    properties = jvm.java.util.Properties()
    for k, v in db.options.items():
        properties.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(db.url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.execute(sql)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def create_table(spark: SparkSession, db: Connection, table: str, types: dict[str, LogicalType]) -> None:
    _run(spark, db, [create_table_sql(db, table, types)])


def load(
    spark: SparkSession,
    db: Connection,
    table: str,
    batch: DataFrame,
    types: dict[str, LogicalType],
    policy: Policy | str,
    boxed: bool = False,
    batch_size: int = 10_000,
) -> None:
    """Load a typed batch, with its order column, into a database table; all of it or nothing.

    The rows are first written to the shared folder, which fixes random keys. Executors then fill a staging table in
    parallel; a task repeated after its commit leaves equal rows twice, which the final statement folds.
    """
    policy = Policy.of(policy)
    partial = boxed and policy is Policy.UPDATE
    written = scratch_dir(spark, "jdbc-staging")
    staging_rows(db, batch, policy, boxed).write.parquet(written)
    rows = spark.read.parquet(written)
    if policy is Policy.FAIL:
        upsert.refuse_conflicts(None, rows, find_key(types))
    staging = f"{table}__staging_{uuid.uuid4().hex[:8]}"
    columns = [c for c in rows.columns if c in types]
    staged_types = {c: types.get(c, LogicalType.INT) for c in rows.columns}
    _run(spark, db, [create_table_sql(db, staging, staged_types, keyed=False)])
    try:
        (
            rows.write.format("jdbc").options(**db.reader_options())
            .option("dbtable", db.quote(staging))
            .option("batchsize", batch_size)
            .mode("append").save()
        )
        _run(spark, db, load_sql(db, table, staging, columns, policy, partial))
    finally:
        _run(spark, db, [f"DROP TABLE {db.quote(staging)}"])
