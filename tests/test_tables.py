"""Keyed tables: atomic loads, updates that write what they change, reports, listing."""

import pytest
from pyspark.sql import functions as F

from tabflow import tables, versions
from tabflow.operators import upsert
from tabflow.operators.upsert import KeyConflictError
from tabflow.runtime import ORD
from tabflow.types import LogicalType as L

TYPES = {"Id": L.LONG, "v": L.STRING, "n": L.DOUBLE}


def batch(spark, rows):
    data = [(*r, (i,)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"Id long, v string, n double, {ORD} struct<m:int>")


def content(spark, name):
    return sorted(map(tuple, tables.scan(spark, name).collect()))


@pytest.fixture
def name(spark, database):
    full = f"{database}.t"
    tables.create_and_load(
        spark, full, TYPES, batch(spark, [(i, f"v{i}", i / 2) for i in range(200)]), "fail", buckets=8
    )
    return full


def expected(changes, n=200):
    rows = {i: (i, f"v{i}", i / 2) for i in range(n)}
    rows.update({r[0]: r for r in changes})
    return sorted(rows.values())


def test_create_refuses_an_existing_name(spark, name):
    with pytest.raises(tables.TableExistsError):
        tables.create_table(spark, name, TYPES)
    with pytest.raises(tables.TableExistsError):
        tables.create_and_load(spark, name, TYPES, batch(spark, [(1, "x", 1.0)]), "fail")
    assert content(spark, name) == expected([])


def test_empty_table(spark, database):
    tables.create_table(spark, f"{database}.e", {"v": L.STRING}, buckets=2)
    assert tables.scan(spark, f"{database}.e").columns == ["Id", "v"]
    assert content(spark, f"{database}.e") == []
    assert tables.types_of(spark, f"{database}.e")["Id"] is L.UUID
    batch_rows = spark.createDataFrame([("k", "x", (1,)), ("k", "y", (2,))], f"Id string, v string, {ORD} struct<m:int>")
    tables.load(spark, f"{database}.e", batch_rows, "update")
    assert content(spark, f"{database}.e") == [("k", "y")]


def test_failed_load_changes_nothing(spark, name):
    before = tables.state(spark, name)
    for rows in ([(500, "n", 1.0), (3, "x", 1.0)], [(500, "n", 1.0), (500, "m", 1.0)]):
        with pytest.raises(KeyConflictError):
            tables.load(spark, name, batch(spark, rows), "fail")
    bad = batch(spark, [(600, "n", 1.0)]).withColumn("v", F.raise_error(F.lit("boom")).cast("string"))
    for policy in ("fail", "ignore", "update"):
        with pytest.raises(Exception, match="boom"):
            tables.load(spark, name, bad, policy)
    assert tables.state(spark, name) == before
    assert content(spark, name) == expected([])


def test_failed_creation_leaves_no_table(spark, database):
    with pytest.raises(KeyConflictError):
        tables.create_and_load(spark, f"{database}.x", TYPES, batch(spark, [(1, "a", 1.0), (1, "b", 1.0)]), "fail")
    assert tables.list_tables(spark, database).collect() == []
    tables.create_and_load(spark, f"{database}.x", TYPES, batch(spark, [(1, "a", 1.0)]), "fail")


def written(spark, name):
    """Rows of each load, in the order of the loads."""
    counts = spark.table(f"{name}__rows").groupBy("_load").count().collect()
    return [r["count"] for r in sorted(counts, key=lambda r: r["_load"])]


def test_fail_and_ignore_only_add(spark, name):
    first = tables.state(spark, name).loads
    tables.load(spark, name, batch(spark, [(300, "n", 1.0)]), "fail")
    tables.load(spark, name, batch(spark, [(300, "no", 2.0), (3, "no", 2.0), (301, "a", 3.0), (301, "b", 4.0)]), "ignore")
    now = tables.state(spark, name)
    assert now.loads[: len(first)] == first and len(now.loads) == 3 and not now.again
    assert written(spark, name) == [200, 1, 1]
    assert content(spark, name) == expected([(300, "n", 1.0), (301, "a", 3.0)])


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_update_writes_what_it_changes(spark, name, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        tables.load(spark, name, batch(spark, [(7, "x", 1.0), (900, "n", 2.0), (7, "y", None)]), "update")
        tables.load(spark, name, batch(spark, [(900, "m", 3.0), (8, "z", None)]), "update")
        rows = [(7, "y", None), (8, "z", None), (900, "m", 3.0)]
        assert content(spark, name) == expected(rows)
        tables.load(spark, name, batch(spark, [(901, "k", 3.0)]), "update")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    now = tables.state(spark, name)
    assert written(spark, name) == [200, 2, 2, 1] and len(now.again) == 2
    assert content(spark, name) == expected(rows + [(901, "k", 3.0)])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_batch_does_not_shuffle_the_target(spark, name):
    """Above the broadcast limit, joins with the target use its buckets; so does the view after an update."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        staged = batch(spark, [(i, "x", 1.0) for i in range(100, 300)]).drop(ORD)
        for target in (tables.scan(spark, name), None):
            if target is None:
                tables.load(spark, name, batch(spark, [(7, "x", 1.0)]), "update")
                target = tables.scan(spark, name)
                view = plan_of(target)
                assert "SortMergeJoin" in view and "Exchange" not in view
            for rows in (upsert.merge(target, staged, "Id", False), upsert.changes(target, staged, "Id", False)):
                plan = plan_of(rows)
                assert "SortMergeJoin" in plan
                # Only the batch's own rows go through exchanges: below each stands the local frame, not the table.
                for below in plan.split("Exchange hashpartitioning")[1:]:
                    assert below.index("Scan ExistingRDD") < (below + "FileScan").index("FileScan")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scan_prunes_loads_and_columns(spark, name):
    tables.load(spark, name, batch(spark, [(7, "x", 1.0)]), "update")
    plan = plan_of(tables.scan(spark, name).filter("Id = 7").select("v"))
    assert "_load" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "EqualTo(Id,7)" in plan
    assert "ReadSchema: struct<Id:bigint,v:string>" in plan


def test_reports(spark, name):
    rows = [(300, "n", 1.0), (3, "x", 2.0), (301, "a", 3.0), (301, "b", 4.0), (3, "y", None)]
    fresh = [(400, "n", 1.0), (401, "m", 1.0)]
    assert tables.load(spark, name, batch(spark, fresh), "fail") == tables.LoadReport("fail", 2, 2)
    assert tables.load(spark, name, batch(spark, rows[:1] + rows[1:2]), "ignore") == tables.LoadReport("ignore", 2, 1, ignored=1)
    assert tables.load(spark, name, batch(spark, rows), "update") == tables.LoadReport("update", 5, 1, 2, combined=2)
    assert tables.load(spark, name, batch(spark, []), "update") == tables.LoadReport("update")
    assert content(spark, name) == expected([(300, "n", 1.0), (3, "y", None), (301, "b", 4.0), *fresh])


def test_a_report_takes_no_second_scan(spark, name):
    """The batch's rows are counted by the write that reads them."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = batch(spark, [(1000 + i, "n", 1.0) for i in range(50)])
    for policy, times in (("update", 1), ("ignore", 1)):
        reads.value = 0
        tables.load(spark, name, rows.mapInArrow(count, rows.schema), policy)
        assert reads.value == 50 * times


def test_late_text_columns_join_a_live_table(spark, name):
    rows = spark.createDataFrame([(3, "late", (1,)), (500, "new", (2,))], f"Id long, w string, {ORD} struct<m:int>")
    tables.load(spark, name, rows, "update")
    got = tables.scan(spark, name)
    assert got.columns == ["Id", "v", "n", "w"]
    changed = {3: (3, "v3", 1.5, "late"), 500: (500, None, None, "new")}
    assert sorted(map(tuple, got.collect())) == sorted(({i: (i, f"v{i}", i / 2, None) for i in range(200)} | changed).values())
    assert written(spark, name) == [200, 2]  # the old rows were not written again
    bad = rows.withColumnRenamed("w", "u").withColumn("Id", F.raise_error(F.lit("boom")).cast("long"))
    with pytest.raises(Exception, match="boom"):
        tables.load(spark, name, bad, "update")
    assert tables.scan(spark, name).columns == ["Id", "v", "n", "w"]


def test_compaction(spark, database):
    full = f"{database}.c"
    tables.create_and_load(spark, full, TYPES, batch(spark, [(0, "v", 0.0)]), "fail", buckets=2)
    for i in range(1, 6):
        tables.load(spark, full, batch(spark, [(i, "v", 0.0), (0, f"u{i}", 0.0)]), "ignore" if i % 2 else "update")
    rows = [(0, "u4", 0.0)] + [(i, "v", 0.0) for i in range(1, 6)]
    assert content(spark, full) == rows
    tables.compact(spark, full)
    now = tables.state(spark, full)
    assert len(now.loads) == 1 and not now.again
    assert content(spark, full) == rows
    tables.drop_superseded(spark, full)
    assert content(spark, full) == rows and written(spark, full) == [6]
    tables.load(spark, full, batch(spark, [(1, "w", 1.0), (9, "n", 1.0)]), "update")
    assert content(spark, full) == [rows[0], (1, "w", 1.0), *rows[2:], (9, "n", 1.0)]


def test_batches_of_a_stream_load_once(spark, name):
    for number in (0, 1, 1, 0, 2):
        tables.load(spark, name, batch(spark, [(700 + number, f"b{number}", 1.0)]), "fail", stream=("s", number))
    assert dict(tables.state(spark, name).streams) == {"s": 2}
    tables.load(spark, name, batch(spark, [(800, "o", 1.0)]), "fail", stream=("other", 0))
    assert content(spark, name) == expected([(700 + i, f"b{i}", 1.0) for i in range(3)] + [(800, "o", 1.0)])


def test_a_load_inside_the_publish_of_another_is_not_lost(spark, name, monkeypatch):
    """Between reading the state and showing the new one, a second load comes through."""
    show = versions.show

    def slow(spark_, name_, now):
        monkeypatch.setattr(versions, "show", show)
        tables.load(spark, name, batch(spark, [(800, "other", 1.0)]), "fail")
        show(spark_, name_, now)

    monkeypatch.setattr(versions, "show", slow)
    tables.load(spark, name, batch(spark, [(801, "mine", 1.0)]), "fail")
    tables.load(spark, name, batch(spark, [(802, "later", 1.0)]), "fail")
    assert content(spark, name) == expected([(800, "other", 1.0), (801, "mine", 1.0), (802, "later", 1.0)])


def test_a_version_that_was_taken_is_shown_by_the_next_load(spark, name, monkeypatch):
    show = versions.show

    def dies(*args):
        raise OSError("the driver is gone")

    monkeypatch.setattr(versions, "show", dies)
    with pytest.raises(OSError):
        tables.load(spark, name, batch(spark, [(800, "first", 1.0)]), "fail")
    monkeypatch.setattr(versions, "show", show)
    tables.load(spark, name, batch(spark, [(801, "second", 1.0)]), "fail")
    assert content(spark, name) == expected([(800, "first", 1.0), (801, "second", 1.0)])


def test_cleaning_up_spares_a_running_load(spark, name, monkeypatch):
    written = tables._write

    def slow(*args):
        out = written(*args)
        tables.drop_superseded(spark, name)
        return out

    monkeypatch.setattr(tables, "_write", slow)
    tables.load(spark, name, batch(spark, [(801, "mine", 1.0), (3, "x", 1.0)]), "update")
    assert content(spark, name) == expected([(801, "mine", 1.0), (3, "x", 1.0)])


def test_small_update_does_not_shuffle_the_target(spark, name, tmp_path):
    """The batch is read from its files, so its size is known."""
    batch(spark, [(7, "x", 1.0)]).drop(ORD).write.parquet(f"{tmp_path}/staged")
    staged = spark.read.parquet(f"{tmp_path}/staged")
    plan = upsert.merge(tables.scan(spark, name), staged, "Id", boxed=False)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in plan


def test_a_second_writer_is_noticed(spark, name, monkeypatch):
    written = tables._write

    def slow(*args):
        out = written(*args)
        monkeypatch.setattr(tables, "_write", written)
        tables.load(spark, name, batch(spark, [(800, "other", 1.0)]), "fail")
        return out

    monkeypatch.setattr(tables, "_write", slow)
    with pytest.raises(tables.ConcurrentLoadError):
        tables.load(spark, name, batch(spark, [(801, "mine", 1.0)]), "fail")
    assert content(spark, name) == expected([(800, "other", 1.0)])


@pytest.mark.parametrize("policy", ["fail", "ignore", "update"])
def test_key_of_another_type_meets_the_stored_one(spark, name, policy):
    narrow = batch(spark, [(i, "x", None) for i in range(150, 250)]).withColumn("Id", F.col("Id").cast("int"))
    if policy == "fail":
        with pytest.raises(KeyConflictError):
            tables.load(spark, name, narrow, policy)
        return
    tables.load(spark, name, narrow, policy)
    first = 150 if policy == "update" else 200
    assert content(spark, name) == expected([(i, "x", None) for i in range(first, 250)])


def test_listing_and_preview(spark, database, name):
    spark.sql(f"CREATE TABLE {database}.plain (x INT) USING parquet")
    spark.sql(f"CREATE VIEW {database}.v AS SELECT * FROM {database}.plain")
    spark.range(3).createOrReplaceTempView("some_temp")
    assert sorted(r[0] for r in tables.list_tables(spark, database).collect()) == ["plain", "t"]
    assert [r["Id"] for r in tables.preview(spark, name, 3, ordered=True).collect()] == [0, 1, 2]
    assert tables.preview(spark, name, 5).count() == 5


def test_state_survives_many_loads(spark, name):
    now = versions.State("it's", 4096, ("Id", "v", "n"), 7, tuple(range(2000)), (5, 9), (("s", 3),))
    assert max(map(len, now.properties().values())) <= 40
    real = versions.State.of(spark, name)
    many = versions.replace(real, loads=tuple(sorted({*real.loads, *range(2000)})), streams=(("a.b", 3),))
    versions.show(spark, name, many)
    assert versions.State.of(spark, name) == many
    assert content(spark, name) == expected([])


def test_buckets_grow_with_the_first_load(spark, database, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 50)
    rows = [(i, f"v{i}", i / 2) for i in range(201)]
    for name, least, expected in (("a", 2, 5), ("b", 8, 8)):
        full = f"{database}.{name}"
        assert tables.create_and_load(spark, full, TYPES, batch(spark, rows), "fail", buckets=least).inserted == 201
        assert tables.state(spark, full).buckets == expected
        assert sorted(map(tuple, tables.scan(spark, full).collect())) == rows
        assert tables.load(spark, full, batch(spark, [(7, "w", 0.0), (500, "x", 1.0)]), "update").updated == 1
        assert tables.scan(spark, full).count() == 202
    with pytest.raises(tables.TableExistsError):
        tables.create_and_load(spark, f"{database}.a", TYPES, batch(spark, rows), "fail")
