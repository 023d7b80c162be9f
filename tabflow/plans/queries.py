"""Registered queries with their SQL equivalents; every one runs over whole tables.

Text inputs are written from the given tables into the shared scratch folder by the engine's own writers, or built
line by line where a query is about text that those writers would never produce.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow import tables
from tabflow.functions import cells
from tabflow.operators import upsert
from tabflow.operators.infer import infer_types, types_frame
from tabflow.operators.transform import Raw, late_keys, transform
from tabflow.plans import pipelines
from tabflow.runtime import ORD, col, scratch_dir
from tabflow.sinks.csv import csv_line, write_lines
from tabflow.sinks.json import write_json_lines, write_objects
from tabflow.sinks.xlsx import write_xlsx
from tabflow.sinks.xml import write_elements
from tabflow.sources import formats
from tabflow.sources.json import read_json
from tabflow.streaming.ingest import ingest_stream
from tabflow.types import KEY, PHYSICAL_TYPES, LogicalType, logical_type

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return register


# --- helpers --------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A given table, its key column renamed."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumnRenamed(key, KEY) if key else df


def database(spark: SparkSession) -> str:
    """A new database in the scratch folder."""
    name = f"tabflow_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_dir(spark, name)}'")
    return name


def as_text(df: DataFrame) -> Raw:
    """Rendered cells of a typed frame, written once, as a file would hold them."""
    cols = [
        F.coalesce(cells.render(col(f.name), logical_type(f)), F.lit("")).alias(f.name) for f in df.schema.fields
    ]
    path = scratch_dir(df.sparkSession, "text")
    df.select(*cols, F.struct(F.lit(0).alias("m")).alias(ORD)).write.parquet(path)
    return Raw(df.sparkSession.read.parquet(path), df.columns, staging=(path,))


def typed(raw: Raw) -> DataFrame:
    """Inferred and converted rows; a key that the engine made up is left out."""
    return transform(raw, infer_types(raw.df, raw.columns)).select(*[col(c) for c in raw.columns])


def round_trip(df: DataFrame, extension: str, **options) -> DataFrame:
    path = scratch_dir(df.sparkSession, "export") + extension
    formats.write(df, path, **options)
    return typed(formats.read(df.sparkSession, path, **options))


def stored(df: DataFrame, name: str, key: str = KEY) -> str:
    """Qualified name of a new keyed table with these rows."""
    spark = df.sparkSession
    full = f"{database(spark)}.{name}"
    batch = df.select(*[col(c) for c in df.columns], F.struct(F.lit(0).alias("m")).alias(ORD))
    tables.create_and_load(spark, full, {f.name: logical_type(f) for f in df.schema.fields}, batch, "fail", buckets=8)
    return full


def one_line(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


ONE_LINE_SQL = "translate(text, chr(13) || chr(10), '  ')"

ORDERS_SQL = 'SELECT o_orderkey AS "Id", o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders'
CUSTOMER_SQL = (
    'SELECT c_custkey AS "Id", c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer'
)


# --- readers and writers --------------------------------------------------------------------------------------


@query("csv_roundtrip_orders", ORDERS_SQL)
def csv_roundtrip_orders(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "orders", "o_orderkey"), ".csv")


@query(
    "csv_quote_grammar",
    f"""
    SELECT doc_id AS "Id", lang || source || ',' || lang || 'x' AS mid,
           CASE WHEN trim({ONE_LINE_SQL}) = '' THEN NULL ELSE {ONE_LINE_SQL} END AS body,
           source || ',' || lang AS unclosed
    FROM documents
    """,
)
def csv_quote_grammar(spark, sf_dir):
    """Quotes in mid-cell, doubled quotes in whole texts, and a quote that the line end closes."""
    d = table(spark, sf_dir, "documents")
    q = F.lit('"')
    lines = d.select(
        F.concat_ws(
            ",",
            d.doc_id.cast("string"),
            F.concat(d.lang, q, d.source, F.lit(","), d.lang, q, F.lit("x")),
            cells.csv_escape(one_line(d.text)),
            F.concat(q, d.source, F.lit(","), d.lang),
        )
    )
    path = scratch_dir(spark, "lines") + ".csv"
    write_lines(lines, "Id,mid,body,unclosed", path)
    return typed(formats.read(spark, path))


BLANK_SQL = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''"


@query(
    "csv_multiline_documents",
    f"""SELECT doc_id AS "Id", CASE WHEN {BLANK_SQL} THEN NULL ELSE text END AS text, lang, source, n_chars FROM documents""",
)
def csv_multiline_documents(spark, sf_dir):
    """Whole texts, line ends included; files are cut wherever a split ends, within a text or not."""
    return round_trip(table(spark, sf_dir, "documents", "doc_id"), ".csv", multiline=True)


@query(
    "csv_ragged_rows",
    """
    SELECT o_orderkey AS "Id", o_custkey AS cust,
           CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status,
           CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price
    FROM orders
    """,
)
def csv_ragged_rows(spark, sf_dir):
    """Short rows, surplus cells and blank lines."""
    o = table(spark, sf_dir, "orders")
    key = F.concat_ws(",", o.o_orderkey, o.o_custkey)
    full = F.concat_ws(",", key, o.o_orderstatus, cells.render_number(o.o_totalprice))
    lines = o.select(
        F.when(o.o_orderstatus == "F", key)
        .when(o.o_orderstatus == "O", F.concat(full, F.lit(",surplus,cells")))
        .otherwise(F.concat(full, F.lit("\n \t \n")))
    )
    path = scratch_dir(spark, "lines") + ".csv"
    write_lines(lines, "Id,cust,status,price", path)
    return typed(formats.read(spark, path))


@query("duplicate_headers", 'SELECT s_suppkey AS "Id", s_acctbal AS a, s_name AS b FROM supplier')
def duplicate_headers(spark, sf_dir):
    """Of two columns named `a` the last one counts, at the place of the first."""
    s = table(spark, sf_dir, "supplier")
    lines = s.select(F.concat_ws(",", s.s_suppkey, s.s_nationkey, s.s_name, cells.render_number(s.s_acctbal)))
    path = scratch_dir(spark, "lines") + ".csv"
    write_lines(lines, "Id,a,b,a", path)
    return typed(formats.read(spark, path))


EVENTS_SQL = 'SELECT event_id AS "Id", ts, user_id, event_type, value, props FROM events'


@query("json_roundtrip_events", EVENTS_SQL)
def json_roundtrip_events(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "events", "event_id"), ".json")


@query(
    "json_nested_events",
    """SELECT event_id AS "Id", props, '[' || user_id || ',"' || event_type || '"]' AS tags
       FROM events""",
)
def json_nested_events(spark, sf_dir):
    """Nested objects and arrays stay JSON text."""
    e = table(spark, sf_dir, "events")
    objects = e.select(
        F.format_string('{"Id":%d,"props":%s,"tags":[%d,"%s"]}', e.event_id, e.props, e.user_id, e.event_type)
    )
    path = scratch_dir(spark, "objects") + ".json"
    write_objects(objects, path)
    return typed(formats.read(spark, path))


@query(
    "json_mixed_text",
    """SELECT event_id AS "Id", CASE event_id % 3 WHEN 0 THEN event_id || '.50' WHEN 1 THEN 'True' ELSE event_type END AS v
       FROM events""",
)
def json_mixed_text(spark, sf_dir):
    """Numbers and booleans in a column of texts keep the document's own digits, and .NET's names."""
    e = table(spark, sf_dir, "events")
    n = e.event_id % 3
    value = F.when(n == 0, F.concat(e.event_id.cast("string"), F.lit(".50"))).when(n == 1, "true")
    value = F.coalesce(value, F.concat(F.lit('"'), e.event_type, F.lit('"')))
    path = scratch_dir(spark, "objects") + ".json"
    write_objects(e.select(F.concat(F.lit('{"Id":'), e.event_id.cast("string"), F.lit(',"v":'), value, F.lit("}"))), path)
    return typed(formats.read(spark, path))


@query("json_lines_roundtrip_events", EVENTS_SQL)
def json_lines_roundtrip_events(spark, sf_dir):
    """One object per line, split by line and parsed where it is read."""
    return round_trip(table(spark, sf_dir, "events", "event_id"), ".jsonl")


@query(
    "json_large_first_object",
    """SELECT doc_id AS "Id", CASE WHEN doc_id = 0 THEN repeat('}x', 600000) WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN text END AS v FROM documents""",
)
def json_large_first_object(spark, sf_dir):
    """An object of more than a megabyte with braces in its text comes first."""
    d = table(spark, sf_dir, "documents")
    v = F.when(d.doc_id == 0, F.repeat(F.lit("}x"), F.lit(600_000))).otherwise(d.text)
    path = scratch_dir(spark, "objects") + ".json"
    write_objects(d.select(F.to_json(F.struct(d.doc_id.alias("Id"), v.alias("v")))), path)
    return typed(formats.read(spark, path))


@query(
    "json_any_layout",
    f"""
    SELECT doc_id AS "Id", CASE WHEN {BLANK_SQL} THEN NULL ELSE text END AS text,
           '[{{"Id":' || doc_id || '}},{{"Id": 0}}]' AS parts FROM documents
    UNION ALL SELECT -1 - event_id, event_type || '}},{{', NULL FROM events
    """,
)
def json_any_layout(spark, sf_dir):
    """Files of two layouts in one folder; objects like the rows, and braces in texts, stand inside the rows."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    nested = d.select(F.concat(
        F.lit('{"Id":'), d.doc_id.cast("string"), F.lit(',"text":'), F.substring(F.to_json(F.struct("text")), F.lit(9), F.length(F.to_json(F.struct("text"))) - 9),
        F.lit(',"parts":[{"Id":'), d.doc_id.cast("string"), F.lit('},{"Id": 0}]}'),
    ))
    spread = e.select(F.format_string('  {\n "Id" : %d ,\n "text" : "%s},{" }', -1 - e.event_id, e.event_type))
    folder = scratch_dir(spark, "objects") + ".json"
    write_objects(nested, f"{folder}/0")
    write_objects(spread, f"{folder}/1")
    raw = read_json(spark, [f"{folder}/0", f"{folder}/1"], extra=["Id", "text", "parts"])
    return typed(raw)


@query(
    "json_heterogeneous",
    """
    SELECT o_orderkey AS "Id", CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS price,
           o_orderstatus <> 'F' AS has_price
    FROM orders
    """,
)
def json_heterogeneous(spark, sf_dir):
    """An absent name and an explicit null are told apart."""
    o = table(spark, sf_dir, "orders")
    price = F.when(o.o_orderstatus == "O", F.concat(F.lit(',"price":'), cells.render_number(o.o_totalprice))).when(
        o.o_orderstatus == "P", ',"price":null'
    )
    objects = o.select(
        F.concat(F.lit('{"Id":'), o.o_orderkey.cast("string"), F.coalesce(price, F.lit("")), F.lit("}"))
    )
    path = scratch_dir(spark, "objects") + ".json"
    write_objects(objects, path)
    raw = read_json(spark, path, extra=["price"])
    types = {"Id": LogicalType.LONG, "price": LogicalType.DOUBLE}
    boxed = transform(raw, types, boxed=True)
    return boxed.select("Id", F.col("price.v").alias("price"), F.col("price").isNotNull().alias("has_price"))


@query(
    "late_keys_report",
    """SELECT event_type AS late_key, count(*) AS n_rows FROM events GROUP BY event_type""",
)
def late_keys_report(spark, sf_dir):
    """Names that the schema from the first row lacks, with the number of rows that carry them."""
    e = table(spark, sf_dir, "events")
    objects = e.select(
        F.format_string('{"Id":%d%s}', e.event_id, F.concat(F.lit(',"'), e.event_type, F.lit('":1')))
    )
    first = spark.range(1).select(F.lit('{"Id":-1}'))
    folder = scratch_dir(spark, "objects") + ".json"
    write_objects(first, f"{folder}/0")
    write_objects(objects, f"{folder}/1")
    return late_keys(read_json(spark, [f"{folder}/0", f"{folder}/1"]))


SUPPLIER_SQL = (
    'SELECT s_suppkey AS "Id", s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier'
)


@query("xml_roundtrip_supplier", SUPPLIER_SQL)
def xml_roundtrip_supplier(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "supplier", "s_suppkey"), ".xml")


@query(
    "xml_roundtrip_pages",
    """SELECT page_id AS "Id", url, replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS html
       FROM pages""",
)
def xml_roundtrip_pages(spark, sf_dir):
    """Cells full of markup."""
    return round_trip(table(spark, sf_dir, "pages", "page_id"), ".xml")


@query(
    "xml_nested_documents",
    """SELECT doc_id AS "Id", 'a' || lang || source || 'z' AS v,
              '<' || replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || '>' AS text
       FROM documents""",
)
def xml_nested_documents(spark, sf_dir):
    """The value of a column with elements inside is all its text."""
    d = table(spark, sf_dir, "documents")
    text = F.replace(F.replace(d.text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    text = F.replace(text, F.lit("]]>"), F.lit("]]&gt;"))
    elements = d.select(
        F.format_string(
            '<Item n="1"><Id>%d</Id><v>a<b k=">">%s</b><![CDATA[%s]]>z</v><text><![CDATA[<]]><i>%s</i>&gt;</text></Item>',
            d.doc_id, d.lang, d.source, text,
        )
    )
    folder = scratch_dir(spark, "elements") + ".xml"
    write_elements(elements, folder)
    return typed(formats.read(spark, folder))


@query(
    "xml_sanitized_names",
    """SELECT s_suppkey AS "Id", s_acctbal AS "FullName", CAST(s_nationkey AS BIGINT) AS "_1st", s_name AS "Column"
       FROM supplier""",
)
def xml_sanitized_names(spark, sf_dir):
    """Names reduced to element names; of two that become equal the last one stays."""
    s = table(spark, sf_dir, "supplier")
    named = s.select(
        s.s_suppkey.alias("Id"),
        s.s_name.alias("Full Name"),
        s.s_nationkey.alias("1st"),
        s.s_name.alias("Имя"),
        s.s_acctbal.alias("Full-Name"),
    )
    return round_trip(named, ".xml")


@query("xlsx_roundtrip_customer", CUSTOMER_SQL)
def xlsx_roundtrip_customer(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "customer", "c_custkey"), ".xlsx")


@query("xlsx_ingest_nation", 'SELECT CAST(n_nationkey AS BIGINT) AS "Id", n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation')
def xlsx_ingest_nation(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "nation", "n_nationkey"), ".xlsx")


@query("xlsx_roundtrip_orders", ORDERS_SQL.replace(" FROM orders", ", o_orderstatus = 'F' AS done FROM orders"))
def xlsx_roundtrip_orders(spark, sf_dir):
    """Dates and booleans in native cells."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    return round_trip(o.withColumn("done", o.o_orderstatus == "F"), ".xlsx")


@query("xlsx_export_manifest", "SELECT count(*) AS n_rows, true AS within_limit, count(*) > 500 AS several FROM orders")
def xlsx_export_manifest(spark, sf_dir):
    """Rows over all workbooks of an export, none of which is above the size asked for."""
    path = scratch_dir(spark, "export") + ".xlsx"
    manifest = write_xlsx(table(spark, sf_dir, "orders", "o_orderkey"), path, rows_per_file=500)
    return manifest.agg(
        F.sum("n_rows").alias("n_rows"),
        (F.max("n_rows") <= 500).alias("within_limit"),
        (F.count("*") > 1).alias("several"),
    )


# --- inference and transformation -----------------------------------------------------------------------------


def _text_sql(column: str, kind: str) -> str:
    if kind == "double":
        plain = f"CAST({column} AS VARCHAR)"
        return f"CASE WHEN {plain} LIKE '%.0' THEN left({plain}, length({plain}) - 2) ELSE {plain} END"
    if kind == "datetime":
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({column} AS VARCHAR)"


def _types_sql(name: str, columns: dict[str, str]) -> str:
    """Inferred type per column, from the text of every cell."""
    parts = []
    for column, kind in columns.items():
        text = _text_sql(column, kind)
        parts.append(
            f"""
            SELECT '{column}' AS column_name, CASE
              WHEN count(x) = 0 THEN 'string'
              WHEN bool_and(regexp_full_match(x, '[0-9a-fA-F]{{32}}|[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')) THEN 'uuid'
              WHEN bool_and(lower(trim(x)) IN ('true', 'false')) THEN 'bool'
              WHEN bool_and(regexp_full_match(x, '\\s*[+-]?[0-9]+\\s*') AND TRY_CAST(trim(x) AS BIGINT) IS NOT NULL) THEN 'long'
              WHEN bool_and(regexp_full_match(x, '\\s*[+-]?([0-9][0-9,]*([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*')) THEN 'double'
              WHEN bool_and(regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9:.]+)?')) THEN 'datetime'
              ELSE 'string' END AS column_type
            FROM (SELECT {text} AS x FROM {name}) WHERE trim(x) <> ''
            """
        )
    return " UNION ALL ".join(parts)


LINEITEM_COLUMNS = {
    "l_orderkey": "long",
    "l_partkey": "long",
    "l_suppkey": "long",
    "l_linenumber": "long",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "datetime",
}
ORDERS_COLUMNS = {
    "o_orderkey": "long",
    "o_custkey": "long",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "datetime",
    "o_orderpriority": "string",
}
EVENTS_COLUMNS = {
    "event_id": "long",
    "ts": "datetime",
    "user_id": "long",
    "event_type": "string",
    "value": "double",
    "props": "string",
}
LABELS_COLUMNS = {"doc_id": "long", "quality": "long", "toxic": "long"}
DOCUMENTS_COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def inferred(raw: Raw) -> DataFrame:
    """(column_name, column_type) by one scan."""
    names = F.array(*[F.lit(c) for c in raw.columns])
    return types_frame(raw.df, raw.columns).select(F.get(names, F.col("i")).alias("column_name"), "column_type")


def _infer_query(name: str, columns: dict[str, str]) -> None:
    @query(f"infer_types_{name}", _types_sql(name, columns))
    def run(spark, sf_dir):
        return inferred(as_text(table(spark, sf_dir, name)))


_infer_query("orders", ORDERS_COLUMNS)
_infer_query("lineitem", LINEITEM_COLUMNS)
_infer_query("events", EVENTS_COLUMNS)
_infer_query("labels", LABELS_COLUMNS)
_infer_query("documents", DOCUMENTS_COLUMNS)


FLAGS_SQL = "SELECT doc_id, quality = 1 AS good, toxic = 1 AS bad FROM labels"


def flags(spark, sf_dir) -> Raw:
    labels = table(spark, sf_dir, "labels")
    return as_text(labels.select("doc_id", (labels.quality == 1).alias("good"), (labels.toxic == 1).alias("bad")))


@query("infer_types_flags", _types_sql(f"({FLAGS_SQL})", {"doc_id": "long", "good": "bool", "bad": "bool"}))
def infer_types_flags(spark, sf_dir):
    return inferred(flags(spark, sf_dir))


@query("typed_transform_flags", FLAGS_SQL)
def typed_transform_flags(spark, sf_dir):
    return typed(flags(spark, sf_dir))


@query(
    "typed_transform_lineitem",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
           CAST(l_quantity AS BIGINT) AS l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
           l_shipdate
    FROM lineitem
    """,
)
def typed_transform_lineitem(spark, sf_dir):
    return typed(as_text(table(spark, sf_dir, "lineitem")))


@query(
    "datetime_forms_orders",
    """SELECT o_orderkey AS "Id", o_orderdate AS iso, o_orderdate + INTERVAL 14 HOUR AS us, o_orderdate AS named,
              o_orderdate + INTERVAL 9 HOUR AS zoned FROM orders""",
)
def datetime_forms_orders(spark, sf_dir):
    """One date in four notations."""
    o = table(spark, sf_dir, "orders")
    text = o.select(
        o.o_orderkey.cast("string").alias("Id"),
        F.date_format("o_orderdate", "yyyy/M/d").alias("iso"),
        F.concat(F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" 2:00 PM")).alias("us"),
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("named"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T11:00:00.0000000+02:00")).alias("zoned"),
        F.struct(F.lit(0).alias("m")).alias(ORD),
    )
    local = typed(Raw(text, ["Id", "iso", "us", "named", "zoned"]))
    # Offsets are shown in the session's zone; the answer must not depend on where the session runs.
    zone = spark.conf.get("spark.sql.session.timeZone")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("zoned"))
    return local.withColumn("zoned", utc)


@query(
    "guid_forms_documents",
    """
    WITH h AS (SELECT doc_id, md5(text) AS h FROM documents)
    SELECT doc_id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS plain,
           concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS braced FROM h
    """,
)
def guid_forms_documents(spark, sf_dir):
    """UUIDs of 32 digits and in braces become one canonical text."""
    d = table(spark, sf_dir, "documents")
    h = F.md5(d.text)
    dashed = F.regexp_replace(F.upper(h), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "{$1-$2-$3-$4-$5}")
    text = d.select(
        d.doc_id.cast("string").alias("doc_id"),
        h.alias("plain"),
        dashed.alias("braced"),
        F.struct(F.lit(0).alias("m")).alias(ORD),
    )
    return typed(Raw(text, ["doc_id", "plain", "braced"]))


@query(
    "blank_to_null",
    """
    SELECT c_custkey AS "Id", c_name,
           CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS segment,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance
    FROM customer
    """,
)
def blank_to_null(spark, sf_dir):
    """Empty, ASCII and Unicode blanks are NULL in every type."""
    c = table(spark, sf_dir, "customer")
    seg = c.c_mktsegment
    text = c.select(
        c.c_custkey.cast("string").alias("Id"),
        c.c_name,
        F.when(seg == "BUILDING", "").when(seg == "HOUSEHOLD", " \t").when(seg == "MACHINERY", "\u00a0\u3000")
        .otherwise(seg).alias("segment"),
        F.when(seg == "BUILDING", "\u2003").otherwise(cells.render_number(c.c_acctbal)).alias("balance"),
        F.struct(F.lit(0).alias("m")).alias(ORD),
    )
    return typed(Raw(text, ["Id", "c_name", "segment", "balance"]))


@query(
    "surrogate_key",
    "SELECT count(*) AS n_rows, count(*) AS n_keys, 36 AS shortest, 36 AS longest FROM lineitem",
)
def surrogate_key(spark, sf_dir):
    """Rows without a key column get distinct UUIDs, which stay the same on every later read."""
    spark_rows = as_text(table(spark, sf_dir, "lineitem"))
    types = {f.name: logical_type(f) for f in table(spark, sf_dir, "lineitem").schema.fields}
    types = {c: LogicalType.LONG if t is LogicalType.INT else t for c, t in types.items()}
    name = f"{database(spark)}.lineitem"
    tables.create_and_load(spark, name, types, transform(spark_rows, types), "fail", buckets=8)
    size = F.length(KEY)
    return tables.scan(spark, name).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(KEY).alias("n_keys"),
        F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
    )


@query(
    "physical_type_map",
    """
    SELECT column_name, dbms, physical_type FROM (VALUES
      ('l_orderkey', 'sqlite', 'INTEGER'), ('l_orderkey', 'postgres', 'BIGINT'), ('l_orderkey', 'mssql', 'BIGINT'),
      ('l_partkey', 'sqlite', 'INTEGER'), ('l_partkey', 'postgres', 'BIGINT'), ('l_partkey', 'mssql', 'BIGINT'),
      ('l_suppkey', 'sqlite', 'INTEGER'), ('l_suppkey', 'postgres', 'BIGINT'), ('l_suppkey', 'mssql', 'BIGINT'),
      ('l_linenumber', 'sqlite', 'INTEGER'), ('l_linenumber', 'postgres', 'BIGINT'), ('l_linenumber', 'mssql', 'BIGINT'),
      ('l_quantity', 'sqlite', 'INTEGER'), ('l_quantity', 'postgres', 'BIGINT'), ('l_quantity', 'mssql', 'BIGINT'),
      ('l_extendedprice', 'sqlite', 'REAL'), ('l_extendedprice', 'postgres', 'DOUBLE PRECISION'), ('l_extendedprice', 'mssql', 'FLOAT'),
      ('l_discount', 'sqlite', 'REAL'), ('l_discount', 'postgres', 'DOUBLE PRECISION'), ('l_discount', 'mssql', 'FLOAT'),
      ('l_tax', 'sqlite', 'REAL'), ('l_tax', 'postgres', 'DOUBLE PRECISION'), ('l_tax', 'mssql', 'FLOAT'),
      ('l_returnflag', 'sqlite', 'TEXT'), ('l_returnflag', 'postgres', 'TEXT'), ('l_returnflag', 'mssql', 'NVARCHAR(MAX)'),
      ('l_linestatus', 'sqlite', 'TEXT'), ('l_linestatus', 'postgres', 'TEXT'), ('l_linestatus', 'mssql', 'NVARCHAR(MAX)'),
      ('l_shipdate', 'sqlite', 'TEXT'), ('l_shipdate', 'postgres', 'TIMESTAMP'), ('l_shipdate', 'mssql', 'DATETIME2')
    ) AS p(column_name, dbms, physical_type) WHERE (SELECT count(*) FROM lineitem) > 0
    """,
)
def physical_type_map(spark, sf_dir):
    """Column types that each DBMS would get for an inferred table."""
    entries = F.array(
        *[
            F.struct(F.lit(t.value).alias("logical"), F.lit(dbms).alias("dbms"), F.lit(ddl).alias("physical_type"))
            for dbms, types in PHYSICAL_TYPES.items()
            for t, ddl in types.items()
        ]
    )
    types = inferred(as_text(table(spark, sf_dir, "lineitem")))
    return (
        types.select("column_name", "column_type", F.explode(entries).alias("e"))
        .filter("e.logical = column_type")
        .select("column_name", "e.dbms", "e.physical_type")
    )


@query(
    "csv_escape_lines",
    """
    WITH q AS (SELECT *, chr(34) AS q FROM documents)
    SELECT doc_id, doc_id || ',' ||
           CASE WHEN contains(text, ',') OR contains(text, q) THEN q || replace(text, q, q || q) || q ELSE text END
           || ',' || lang || ',' || source || ',' || n_chars AS line
    FROM q
    """,
)
def csv_escape_lines(spark, sf_dir):
    """Cells are quoted for a comma or a quote, not for a line break."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", csv_line(d).alias("line"))


@query(
    "render_values_events",
    f"""
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, {_text_sql('value', 'double')} AS value_text,
           CASE WHEN value > 50 THEN 'True' ELSE 'False' END AS flag_text, CAST(user_id AS VARCHAR) AS user_text
    FROM events
    """,
)
def render_values_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("flag", F.col("value") > 50)

    def text(name: str) -> Column:
        return cells.render(col(name), logical_type(e.schema[name]))

    return e.select(
        "event_id",
        text("ts").alias("ts_text"),
        text("value").alias("value_text"),
        text("flag").alias("flag_text"),
        text("user_id").alias("user_text"),
    )


# --- tables ---------------------------------------------------------------------------------------------------

PART_SQL = "SELECT p_partkey AS \"Id\", p_name, p_brand, p_type, p_size, p_retailprice FROM part"


@query("table_scan_part", PART_SQL)
def table_scan_part(spark, sf_dir):
    return tables.scan(spark, stored(table(spark, sf_dir, "part", "p_partkey"), "part"))


@query("create_table_customer", CUSTOMER_SQL)
def create_table_customer(spark, sf_dir):
    """Create from inferred types, then load."""
    raw = as_text(table(spark, sf_dir, "customer", "c_custkey"))
    types = infer_types(raw.df, raw.columns)
    name = f"{database(spark)}.customer"
    tables.create_table(spark, name, types, buckets=4)
    tables.load(spark, name, transform(raw, types), "fail")
    return tables.scan(spark, name)


@query("list_tables", "SELECT unnest(['nation', 'region']) AS table_name WHERE (SELECT count(*) FROM nation) > 0")
def list_tables(spark, sf_dir):
    """A database with two loaded tables and a plain view, which is not listed."""
    db = database(spark)
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        raw = as_text(table(spark, sf_dir, name, key))
        types = infer_types(raw.df, raw.columns)
        tables.create_and_load(spark, f"{db}.{name}", types, transform(raw, types), "fail")
    spark.sql(f"CREATE VIEW {db}.some_view AS SELECT * FROM {db}.nation")
    return tables.list_tables(spark, db)


@query("preview_orders", ORDERS_SQL + " ORDER BY o_orderkey LIMIT 1000")
def preview_orders(spark, sf_dir):
    return tables.preview(spark, stored(table(spark, sf_dir, "orders", "o_orderkey"), "orders"), 1000, ordered=True)


@query("failed_load_keeps_table", CUSTOMER_SQL.replace("CAST(c_nationkey AS BIGINT) AS c_nationkey", "c_nationkey"))
def failed_load_keeps_table(spark, sf_dir):
    """A batch with clashing keys changes nothing, its other rows included."""
    customers = table(spark, sf_dir, "customer", "c_custkey")
    name = stored(customers, "customer")
    o = table(spark, sf_dir, "orders")
    clashing = o.select(
        o.o_custkey.alias("Id"), o.o_orderstatus.alias("c_name"), F.struct("o_orderkey").alias(ORD)
    )
    try:
        tables.load(spark, name, clashing, "fail")
    except upsert.KeyConflictError:
        return tables.scan(spark, name)
    raise AssertionError("the load should have failed")


# --- conflict policies ----------------------------------------------------------------------------------------

# The target: customers. The batch: all line items under their order key, so that some keys are stored, others are
# new, and most come several times. The order is total up to equal rows.
LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"]
TARGET_SQL = 'SELECT c_custkey AS "Id", c_name AS name, c_acctbal AS amount, c_mktsegment AS segment FROM customer'
_BATCH_ORDER_SQL = ", ".join(LINE_ORDER)


def target_rows(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        c.c_custkey.alias("Id"), c.c_name.alias("name"), c.c_acctbal.alias("amount"), c.c_mktsegment.alias("segment")
    )


def batch_rows(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        li.l_orderkey.alias("Id"),
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("name"),
        li.l_extendedprice.alias("amount"),
        F.struct(*LINE_ORDER).alias(ORD),
    )


def _pick_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in LINE_ORDER)
    return f"""
    SELECT l_orderkey AS "Id", l_returnflag || '/' || l_linestatus AS name, l_extendedprice AS amount
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) = 1
    """


@query(
    "upsert_fail_clean",
    """
    SELECT 'C' || c_custkey AS "Id", c_name AS name FROM customer
    UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier
    """,
)
def upsert_fail_clean(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    stored_rows = c.select(F.concat(F.lit("C"), c.c_custkey).alias("Id"), c.c_name.alias("name"))
    batch = s.select(
        F.concat(F.lit("S"), s.s_suppkey).alias("Id"), s.s_name.alias("name"), F.struct("s_suppkey").alias(ORD)
    )
    return upsert.apply_policy(stored_rows, batch, KEY, "fail")


@query(
    "upsert_fail_conflicts",
    """
    SELECT "Id", n_rows, CASE WHEN c_custkey IS NULL THEN 'batch' WHEN n_rows > 1 THEN 'both' ELSE 'table' END AS clash
    FROM (SELECT l_orderkey AS "Id", count(*) AS n_rows FROM lineitem GROUP BY 1)
    LEFT JOIN customer ON c_custkey = "Id" WHERE c_custkey IS NOT NULL OR n_rows > 1
    """,
)
def upsert_fail_conflicts(spark, sf_dir):
    return upsert.conflicts(target_rows(spark, sf_dir), batch_rows(spark, sf_dir), KEY)


@query(
    "upsert_ignore",
    f"""
    {TARGET_SQL} UNION ALL
    SELECT "Id", name, amount, NULL FROM ({_pick_sql('ASC')}) WHERE "Id" NOT IN (SELECT c_custkey FROM customer)
    """,
)
def upsert_ignore(spark, sf_dir):
    return upsert.apply_policy(target_rows(spark, sf_dir), batch_rows(spark, sf_dir), KEY, "ignore")


UPDATE_SQL = f"""
    SELECT coalesce(t."Id", b."Id") AS "Id",
           CASE WHEN b."Id" IS NULL THEN t.name ELSE b.name END AS name,
           CASE WHEN b."Id" IS NULL THEN t.amount ELSE b.amount END AS amount, t.segment
    FROM ({TARGET_SQL}) t FULL JOIN ({_pick_sql('DESC')}) b ON t."Id" = b."Id"
    """


@query("upsert_update", UPDATE_SQL)
def upsert_update(spark, sf_dir):
    return upsert.apply_policy(target_rows(spark, sf_dir), batch_rows(spark, sf_dir), KEY, "update")


def _boxed_batch(spark, sf_dir) -> DataFrame:
    """Each row sets the name, sets the amount (to NULL for some), or both."""
    li = batch_rows(spark, sf_dir)
    flag, status = F.col(ORD)["l_returnflag"], F.col(ORD)["l_linestatus"]
    return li.select(
        "Id",
        F.when(flag == "A", F.struct(F.col("name").alias("v"))).alias("name"),
        F.when(status == "F", F.struct(F.when(flag != "R", F.col("amount")).alias("v"))).alias("amount"),
        ORD,
    )


PARTIAL_SQL = f"""
    SELECT coalesce(t."Id", b."Id") AS "Id",
           CASE WHEN b.name IS NULL THEN t.name ELSE b.name.v END AS name,
           CASE WHEN b.amount IS NULL THEN t.amount ELSE b.amount.v END AS amount, t.segment
    FROM ({TARGET_SQL}) t FULL JOIN (
      SELECT l_orderkey AS "Id",
             arg_max({{'v': l_returnflag || '/' || l_linestatus}}, o) FILTER (l_returnflag = 'A') AS name,
             arg_max({{'v': CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END}}, o) FILTER (l_linestatus = 'F') AS amount
      FROM (SELECT *, row_number() OVER (ORDER BY {_BATCH_ORDER_SQL}) AS o FROM lineitem) GROUP BY 1
    ) b ON t."Id" = b."Id"
    """


@query("upsert_update_partial", PARTIAL_SQL)
def upsert_update_partial(spark, sf_dir):
    return upsert.apply_policy(
        target_rows(spark, sf_dir), _boxed_batch(spark, sf_dir), KEY, "update", boxed=True
    )


@query(
    "upsert_update_hot_keys",
    """
    SELECT coalesce(t."Id", b."Id") AS "Id", coalesce(b.n, t.n) AS n FROM
    (SELECT DISTINCT source AS "Id", CAST(0 AS BIGINT) AS n FROM documents) t FULL JOIN
    (SELECT event_type AS "Id", arg_max(user_id, event_id) AS n FROM events GROUP BY 1) b ON t."Id" = b."Id"
    """,
)
def upsert_update_hot_keys(spark, sf_dir):
    """A handful of keys hold the whole batch; tasks send one row per key to the shuffle."""
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    stored_rows = d.select(d.source.alias("Id")).distinct().withColumn("n", F.lit(0).cast("bigint"))
    batch = e.select(e.event_type.alias("Id"), e.user_id.alias("n"), F.struct("event_id").alias(ORD))
    return upsert.apply_policy(stored_rows, batch, KEY, "update")


# --- whole operations -----------------------------------------------------------------------------------------


@query("add_table_orders", ORDERS_SQL)
def add_table_orders(spark, sf_dir):
    """CSV file to inferred, keyed table."""
    path = scratch_dir(spark, "export") + ".csv"
    formats.write(table(spark, sf_dir, "orders", "o_orderkey"), path)
    name = f"{database(spark)}.orders"
    pipelines.add_table(spark, path, name, "fail", buckets=8)
    return tables.scan(spark, name)


@query(
    "import_into_customer_update",
    """
    SELECT coalesce(c_custkey, o_orderkey) AS "Id", c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
           CASE WHEN o_orderkey IS NULL THEN c_acctbal WHEN o_orderstatus = 'F' THEN NULL
                WHEN o_orderstatus = 'O' THEN o_totalprice ELSE c_acctbal END AS c_acctbal,
           coalesce(o_orderpriority, c_mktsegment) AS c_mktsegment
    FROM customer FULL JOIN orders ON c_custkey = o_orderkey
    """,
)
def import_into_customer_update(spark, sf_dir):
    """JSON objects of which some set the balance, some clear it and some do not have it."""
    o = table(spark, sf_dir, "orders")
    balance = F.when(
        o.o_orderstatus == "O", F.concat(F.lit(',"c_acctbal":'), cells.render_number(o.o_totalprice))
    ).when(o.o_orderstatus == "F", ',"c_acctbal":null')
    objects = o.select(
        F.concat(
            F.lit('{"Id":'), o.o_orderkey.cast("string"), F.lit(',"c_mktsegment":"'), o.o_orderpriority, F.lit('"'),
            F.coalesce(balance, F.lit("")), F.lit("}"),
        )
    )
    path = scratch_dir(spark, "objects") + ".json"
    write_objects(objects, path)
    return _customer_after_import(spark, sf_dir, path, "update")


@query(
    "import_into_customer_ignore",
    """
    SELECT c_custkey AS "Id", c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT o_orderkey, NULL, NULL, o_totalprice, o_orderpriority FROM orders
    WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)
    """,
)
def import_into_customer_ignore(spark, sf_dir):
    """A CSV file with stored and new keys; stored rows stay."""
    o = table(spark, sf_dir, "orders")
    path = scratch_dir(spark, "export") + ".csv"
    formats.write(
        o.select(
            o.o_orderkey.alias("Id"), o.o_totalprice.alias("c_acctbal"), o.o_orderpriority.alias("c_mktsegment")
        ),
        path,
    )
    return _customer_after_import(spark, sf_dir, path, "ignore")


def _customer_after_import(spark, sf_dir, path: str, policy: str) -> DataFrame:
    name = f"{database(spark)}.customer"
    export = scratch_dir(spark, "export") + ".csv"
    formats.write(table(spark, sf_dir, "customer", "c_custkey"), export)
    pipelines.add_table(spark, export, name, "fail", buckets=8)
    pipelines.import_into(spark, path, name, policy)
    return tables.scan(spark, name)


def _export_sql(moment: str) -> str:
    return f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS "Id", CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
           {_text_sql('o_totalprice', 'double')} AS o_totalprice,
           strftime(o_orderdate, '{moment}') AS o_orderdate, o_orderpriority
    FROM orders
    """


def _exported(spark, sf_dir, extension: str) -> DataFrame:
    """Texts in the export of a table."""
    name = stored(table(spark, sf_dir, "orders", "o_orderkey"), "orders")
    path = scratch_dir(spark, "export") + extension
    pipelines.export_table(spark, name, path)
    raw = formats.read(spark, path)
    return raw.df.select(*[col(c) for c in raw.columns])


@query("export_table_orders", _export_sql("%Y-%m-%d %H:%M:%S"))
def export_table_orders(spark, sf_dir):
    return _exported(spark, sf_dir, ".csv")


@query("export_table_json", _export_sql("%Y-%m-%dT%H:%M:%S"))
def export_table_json(spark, sf_dir):
    return _exported(spark, sf_dir, ".json")


@query("export_table_xml", _export_sql("%Y-%m-%d %H:%M:%S"))
def export_table_xml(spark, sf_dir):
    return _exported(spark, sf_dir, ".xml")


@query("export_table_single_file", _export_sql("%Y-%m-%dT%H:%M:%S"))
def export_table_single_file(spark, sf_dir):
    """One JSON file, which its reader splits again."""
    name = stored(table(spark, sf_dir, "orders", "o_orderkey"), "orders")
    path = scratch_dir(spark, "single") + ".json"
    pipelines.export_table(spark, name, path, single_file=True)
    raw = formats.read(spark, path)
    return raw.df.select(*[col(c) for c in raw.columns])


# --- streams, quarantine, reports, late columns ---------------------------------------------------------------


def _empty_like(spark, df: DataFrame, name: str) -> str:
    full = f"{database(spark)}.{name}"
    tables.create_table(spark, full, {f.name: logical_type(f) for f in df.schema.fields}, buckets=4)
    return full


@query("ingest_stream_events", EVENTS_SQL)
def ingest_stream_events(spark, sf_dir):
    """JSON Lines files arrive in two lots; the stream stops between batches and goes on from its checkpoint."""
    e = table(spark, sf_dir, "events", "event_id")
    name = _empty_like(spark, e, "events")
    folder, checkpoint = scratch_dir(spark, "arrivals") + ".jsonl", scratch_dir(spark, "checkpoint")
    half = F.pmod(F.xxhash64("Id"), F.lit(2))
    for lot in (0, 1):
        write_json_lines(e.filter(half == lot).repartition(6), f"{folder}/{lot}")
        ingest_stream(spark, f"{folder}/*", name, checkpoint, "fail", files_per_batch=3).awaitTermination()
    return tables.scan(spark, name)


@query(
    "ingest_stream_update",
    """
    SELECT o_custkey AS "Id", arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price
    FROM orders GROUP BY o_custkey
    """,
)
def ingest_stream_update(spark, sf_dir):
    """CSV files in the order of their rows; every batch updates what the batches before it have stored."""
    o = table(spark, sf_dir, "orders").orderBy("o_orderkey")
    rows = o.select(o.o_custkey.alias("Id"), o.o_orderstatus.alias("status"), o.o_totalprice.alias("price"))
    name = _empty_like(spark, rows, "latest")
    folder = scratch_dir(spark, "arrivals") + ".csv"
    formats.write(rows, folder)
    # All files of one lot are one batch, and their names follow the order of the rows.
    ingest_stream(spark, folder, name, scratch_dir(spark, "checkpoint"), "update", header="Id,status,price").awaitTermination()
    return tables.scan(spark, name)


def _orders_with_faults(spark, sf_dir) -> str:
    """A CSV export of the orders in which every seventh price and every eleventh date is no such thing."""
    o = table(spark, sf_dir, "orders")
    price = F.when(o.o_orderkey % 7 == 0, F.concat(F.lit("("), cells.render_number(o.o_totalprice), F.lit(")"))).otherwise(cells.render_number(o.o_totalprice))
    day = F.when(o.o_orderkey % 11 == 0, F.lit("some day")).otherwise(cells.render(o.o_orderdate, logical_type(o.schema["o_orderdate"])))
    path = scratch_dir(spark, "faults") + ".csv"
    write_lines(o.select(F.concat_ws(",", o.o_orderkey, price, day)), "Id,price,day", path)
    return path


def _quarantined(spark, sf_dir) -> str:
    name = f"{database(spark)}.orders"
    tables.create_table(spark, name, {"Id": LogicalType.LONG, "price": LogicalType.DOUBLE, "day": LogicalType.DATETIME}, buckets=4)
    pipelines.import_into(spark, _orders_with_faults(spark, sf_dir), name, "fail", on_error="quarantine")
    return name


@query(
    "quarantine_orders",
    'SELECT o_orderkey AS "Id", o_totalprice AS price, o_orderdate AS day FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0',
)
def quarantine_orders(spark, sf_dir):
    """Rows whose cells all fit are loaded."""
    return tables.scan(spark, _quarantined(spark, sf_dir))


@query(
    "quarantine_rejects",
    f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, 'price' AS "column", '(' || {_text_sql('o_totalprice', 'double')} || ')' AS text,
           'not a valid double' AS reason FROM orders WHERE o_orderkey % 7 = 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'day', 'some day', 'not a valid datetime' FROM orders WHERE o_orderkey % 11 = 0
    """,
)
def quarantine_rejects(spark, sf_dir):
    """The others are kept with one line per fault."""
    rejects = spark.table(_quarantined(spark, sf_dir) + pipelines.REJECTS_SUFFIX)
    return rejects.select(F.element_at("cells", "Id").alias("id"), "column", "text", "reason")


@query(
    "load_reports",
    """
    WITH b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
    s AS (SELECT sum(n) AS rows, count(*) AS keys, count(*) FILTER (k IN (SELECT c_custkey FROM customer)) AS stored FROM b)
    SELECT 'fail' AS policy, (SELECT count(*) FROM customer) AS read, (SELECT count(*) FROM customer) AS inserted,
           CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS ignored, CAST(0 AS BIGINT) AS combined, CAST(0 AS BIGINT) AS rejected
    UNION ALL SELECT 'ignore', CAST(rows AS BIGINT), keys - stored, 0, CAST(rows - keys + stored AS BIGINT), 0, 0 FROM s
    UNION ALL SELECT 'update', CAST(rows AS BIGINT), keys - stored, stored, 0, CAST(rows - keys AS BIGINT), 0 FROM s
    """,
)
def load_reports(spark, sf_dir):
    """What became of the rows of a load, under each policy: counted by the write itself."""
    customers = target_rows(spark, sf_dir).withColumn(ORD, F.struct("Id"))
    types = {f.name: logical_type(f) for f in target_rows(spark, sf_dir).schema.fields}
    reports = []
    for policy in ("ignore", "update"):
        name = f"{database(spark)}.customers"
        first = tables.create_and_load(spark, name, types, customers, "fail", buckets=4)
        reports.append(tables.load(spark, name, batch_rows(spark, sf_dir), policy))
    columns = [f.name for f in fields(tables.LoadReport)]
    rows = [tuple(getattr(r, c) for c in columns) for r in (first, *reports)]
    return spark.createDataFrame(rows, "policy string, " + ", ".join(f"{c} long" for c in columns[1:]))


@query(
    "late_columns_merge",
    """
    SELECT coalesce(c_custkey, o_orderkey) AS "Id", c_name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority,
           CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status
    FROM customer FULL JOIN orders ON c_custkey = o_orderkey
    """,
)
def late_columns_merge(spark, sf_dir):
    """Names that come up anywhere in a file become text columns of a live table; rows that lack them have NULL."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    name = stored(c.select(c.c_custkey.alias("Id"), "c_name"), "customer")
    member = lambda of, key, value: F.when(o.o_orderkey % of == 0, F.concat(F.lit(f',"{key}":"'), value, F.lit('"')))
    late = [F.coalesce(member(2, "priority", o.o_orderpriority), F.lit("")), F.coalesce(member(3, "status", o.o_orderstatus), F.lit(""))]
    path = scratch_dir(spark, "objects") + ".jsonl"
    o.select(F.concat(F.lit('{"Id":'), o.o_orderkey.cast("string"), *late, F.lit("}"))).write.text(path)
    pipelines.import_into(spark, path, name, "update", late="merge")
    return tables.scan(spark, name).select("Id", "c_name", "priority", "status")
