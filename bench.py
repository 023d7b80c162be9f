"""Headline timings: one JSON line with seconds per operation at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabflow import tables  # noqa: E402
from tabflow.operators.infer import infer_types  # noqa: E402
from tabflow.operators.transform import transform  # noqa: E402
from tabflow.plans import queries as Q  # noqa: E402
from tabflow.runtime import ORD, scratch_dir  # noqa: E402
from tabflow.sources import formats  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tabflow-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{root}/warehouse")
        .config("spark.checkpoint.dir", f"{root}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}

    def timed(name: str, action: Callable):
        start = time.perf_counter()
        out = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    lineitem = Q.table(spark, SF_DIR, "lineitem")
    # Several tasks, so several files: what a reader makes of one file alone says little.
    orders = Q.table(spark, SF_DIR, "orders", "o_orderkey").repartition(int(CPUS))
    folder = scratch_dir(spark, "bench")
    # Code generation and class loading are not what is measured.
    warm = f"{folder}/warm.csv"
    formats.write(Q.table(spark, SF_DIR, "supplier", "s_suppkey"), warm)
    raw = formats.read(spark, warm)
    run(transform(raw, infer_types(raw.df, raw.columns)))

    timed("export_csv_lineitem", lambda: formats.write(lineitem, f"{folder}/lineitem.csv"))
    raw = formats.read(spark, f"{folder}/lineitem.csv")
    types = timed("read_and_infer_csv_lineitem", lambda: infer_types(raw.df, raw.columns))
    timed(
        "typed_transform_parquet_lineitem",
        lambda: transform(raw, types).drop(ORD).write.parquet(f"{folder}/lineitem.parquet"),
    )
    for extension in ("csv", "json", "xml", "xlsx"):
        path = f"{folder}/orders.{extension}"
        timed(f"export_{extension}_orders", lambda p=path: formats.write(orders, p))
        timed(f"read_{extension}_orders", lambda p=path: run(Q.typed(formats.read(spark, p))))

    db = Q.database(spark)
    order_types = {"Id": "long", "o_custkey": "long", "o_orderstatus": "string", "o_totalprice": "double",
                   "o_orderdate": "datetime", "o_orderpriority": "string"}
    order_types = {c: Q.LogicalType(t) for c, t in order_types.items()}
    ordered = orders.withColumn(ORD, F.struct(F.col("Id").alias("m")))
    name = f"{db}.orders"
    timed("create_and_load_orders", lambda: tables.create_and_load(spark, name, order_types, ordered, "fail", buckets=8))
    # The batch: the orders of one status in two versions, and as many new ones.
    some = ordered.filter("o_orderstatus = 'F'")
    twice = some.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn(
        ORD, F.struct((F.col("Id") + 1_000_000_000).alias("m"))
    )
    new = some.withColumn("Id", F.col("Id") + 1_000_000_000)
    batch = some.unionByName(twice).unionByName(new)
    timed("load_update_orders", lambda: tables.load(spark, name, batch, "update"))
    timed("load_ignore_orders", lambda: tables.load(spark, name, batch, "ignore"))
    later = some.withColumn("Id", F.col("Id") + 2_000_000_000)
    timed("load_fail_orders", lambda: tables.load(spark, name, later, "fail"))
    timed("table_scan_orders", lambda: run(tables.scan(spark, name)))

    for query in (
        "json_mixed_text", "xml_nested_documents", "xlsx_roundtrip_orders", "infer_types_lineitem", "infer_types_documents", "typed_transform_lineitem", "csv_quote_grammar",
        "csv_escape_lines", "render_values_events", "upsert_ignore", "upsert_update", "upsert_update_partial",
        "upsert_fail_conflicts", "add_table_orders", "import_into_customer_update",
    ):
        timed(query, lambda q=query: run(Q.QUERIES[q](spark, SF_DIR)))

    print(
        json.dumps(
            {
                "metric": "tabflow_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rpartition("sf")[2].rstrip("/"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
