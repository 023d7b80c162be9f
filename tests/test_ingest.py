"""Streams, quarantine, late columns and JSON Lines."""

import json

import pytest

from tabflow import tables
from tabflow.operators.quarantine import Sorted
from tabflow.plans import pipelines
from tabflow.sources import formats
from tabflow.streaming import ingest
from tabflow.types import LogicalType as L


def content(spark, name):
    return sorted(map(tuple, spark.table(name).collect()), key=str)


@pytest.fixture
def name(spark, database):
    tables.create_table(spark, f"{database}.t", {"Id": L.LONG, "v": L.STRING, "n": L.DOUBLE}, buckets=2)
    return f"{database}.t"


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


# --- JSON Lines


def test_json_lines_keep_the_text_of_cells(spark, file):
    path = file("a.jsonl", '﻿{"a":1.50,"b":"x"}\n\n  \n{"b":true,"a":null,"c":{"d": [1 ,2]}}\r\n{"a":"é\\n"}\n')
    raw = formats.read(spark, path)
    assert raw.columns == ["a", "b"] and raw.staging == ()
    assert [tuple(r) for r in raw.df.select("a", "b", "__late").collect()] == [("1.50", "x", []), ("", "True", ["c"]), ("é\n", None, [])]
    raw = formats.read(spark, path, extra=["c"])
    assert [r["c"] for r in raw.df.select("c").collect()] == [None, '{"d": [1 ,2]}', None]


@pytest.mark.parametrize("bad", ["[1]", '{"a":1} {"a":2}', '{"a":1', "1", '{"a":1},{"a":2}', '{"a":NaN}'])
def test_malformed_lines_abort(spark, file, bad):
    path = file("a.jsonl", '{"a":1}\n' + bad + "\n")
    with pytest.raises(Exception, match="malformed JSON"):
        formats.read(spark, path).df.select("a").collect()


def test_json_lines_split_without_staging(spark, tmp_path):
    spark.range(40_000).selectExpr("id AS Id", "repeat('x', 50) AS v").coalesce(1).selectExpr("to_json(struct(*)) AS value").write.text(str(tmp_path / "a.jsonl"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        raw = formats.read(spark, str(tmp_path / "a.jsonl"))
        assert raw.staging == () and raw.df.rdd.getNumPartitions() > 4
        assert raw.df.select("Id").distinct().count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# --- quarantine


def test_rejects_name_column_text_and_reason(spark, file, name):
    path = file("a.csv", "Id,v,n\n1,x,1.5\n2,y,(5)\nnope,z,also\n,w,2\n5, ,\n")
    report = pipelines.import_into(spark, path, name, "fail", on_error="quarantine")
    assert report == tables.LoadReport("fail", 5, 2, rejected=3)
    assert content(spark, name) == [(1, "x", 1.5), (5, None, None)]
    rejects = spark.table(name + pipelines.REJECTS_SUFFIX)
    got = sorted((r["cells"]["v"], r["column"], r["text"], r["reason"]) for r in rejects.collect())
    assert got == [("w", "Id", "", "the key is blank"), ("y", "n", "(5)", "not a valid double"), ("z", "Id", "nope", "not a valid long"), ("z", "n", "also", "not a valid double")]
    assert all(json.loads(r["place"])["f"].endswith("a.csv") for r in rejects.collect())


def test_rejects_of_partial_rows(spark, file, name):
    rows = [{"Id": 1, "v": "x", "n": 2}, {"Id": 2, "late": 1}, {"v": "no key"}, {"Id": 3, "n": None}, {"Id": 4, "n": "bad"}]
    report = pipelines.import_into(spark, file("a.jsonl", lines(rows)), name, "update", on_error="quarantine")
    assert (report.read, report.inserted, report.rejected) == (5, 2, 3)
    reasons = sorted((r["column"], r["reason"]) for r in spark.table(name + pipelines.REJECTS_SUFFIX).collect())
    assert reasons == [("Id", "the row has no key"), ("late", "not a column of the table"), ("n", "not a valid double")]
    patch = [{"Id": 1, "n": None}, {"Id": 3, "v": "new"}, {"Id": "x"}]
    pipelines.import_into(spark, file("b.jsonl", lines(patch)), name, "update", on_error="quarantine")
    assert content(spark, name) == [(1, "x", None), (3, "new", None)]


def test_rows_and_rejects_come_from_one_pass(spark, file):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    raw = formats.read(spark, file("a.csv", "Id,n\n1,2\n2,x\n3,4\n"))
    raw.df = raw.df.mapInArrow(count, raw.df.schema)
    split = Sorted(raw, {"Id": L.LONG, "n": L.DOUBLE})
    assert (split.read, split.rejected, split.good.count(), split.rejects.count()) == (3, 1, 2, 1)
    assert reads.value == 3
    split.discard()


def test_random_keys_are_drawn_once(spark, database, file):
    name = f"{database}.u"
    tables.create_table(spark, name, {"Id": L.UUID, "n": L.DOUBLE})
    pipelines.import_into(spark, file("a.csv", "n\n1\n2\nx\n"), name, "update", on_error="quarantine")
    rows = content(spark, name)
    assert sorted(r[1] for r in rows) == [1.0, 2.0] and len({r[0] for r in rows}) == 2 and rows == content(spark, name)


def test_wrong_options_are_refused(spark, file, name):
    path = file("a.csv", "Id\n1\n")
    for wrong in ({"on_error": "ignore"}, {"late": "drop"}):
        with pytest.raises(ValueError):
            pipelines.import_into(spark, path, name, **wrong)


# --- late columns


def test_late_columns(spark, file, name):
    pipelines.import_into(spark, file("a.jsonl", lines([{"Id": 1, "v": "a"}])), name)
    rows = [{"Id": 2, "v": "b"}, {"Id": 1, "w": "é", "v": "c"}, {"Id": 3, "w": None, "u": 1.50}]
    pipelines.import_into(spark, file("b.jsonl", lines(rows).replace("1.5}", "1.50}")), name, "update", late="merge")
    assert spark.table(name).columns == ["Id", "v", "n", "u", "w"]
    assert content(spark, name)[0][3:] == (None, "é")
    assert [r[3] for r in content(spark, name)] == [None, None, "1.50"]
    pipelines.import_into(spark, file("c.csv", "Id,zz\n9,x\n"), name, "fail", late="merge")
    assert spark.table(name).columns[-1] == "zz"
    with pytest.raises(ValueError, match="no columns"):
        pipelines.import_into(spark, file("d.csv", "Id,yy\n9,x\n"), name, "fail")


# --- streams


def run(spark, path, name, base, **options):
    options.setdefault("policy", "fail")
    ingest.ingest_stream(spark, path, name, str(base / "checkpoint"), **options).awaitTermination()


def test_stream_goes_on_from_its_checkpoint(spark, name, tmp_path):
    folder, reports = tmp_path / "in.jsonl", []
    folder.mkdir()
    for lot in range(3):
        for part in range(4):
            i = 10 * lot + part
            (folder / f"{lot}{part}.jsonl").write_text(lines([{"Id": i, "v": f"v{i}", "n": i / 2}]))
        run(spark, str(folder), name, tmp_path, files_per_batch=3, reports=reports)
    assert [n for n, _ in reports] == list(range(6)) and [r.inserted for _, r in reports] == [3, 1] * 3
    assert content(spark, name) == sorted(((10 * lot + p, f"v{10 * lot + p}", (10 * lot + p) / 2) for lot in range(3) for p in range(4)), key=str)


def test_a_batch_published_before_the_stream_died_is_not_loaded_again(spark, name, tmp_path, monkeypatch):
    """The rows are published; then the stream dies before its checkpoint has noted the batch."""
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("Id,v,n\n1,a,1\n2,b,2\n")
    load = ingest.load_raw

    def dies(*args):
        load(*args)
        raise OSError("the driver is gone")

    monkeypatch.setattr(ingest, "load_raw", dies)
    with pytest.raises(Exception, match="driver is gone"):
        run(spark, str(folder), name, tmp_path, header="Id,v,n")
    monkeypatch.setattr(ingest, "load_raw", load)
    assert len(content(spark, name)) == 2
    (folder / "b.csv").write_text("Id,v,n\n3,c,3\n")
    reports = []
    run(spark, str(folder), name, tmp_path, header="Id,v,n", reports=reports)  # policy fail: a second load would abort
    assert content(spark, name) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
    assert [r.inserted for _, r in reports] == [1]


def test_a_batch_that_failed_is_loaded_again(spark, name, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("Id,v,n\n1,a,1\n2,b,bad\n")
    with pytest.raises(Exception, match="not a valid double"):
        run(spark, str(folder), name, tmp_path, header="Id,v,n")
    assert content(spark, name) == []
    run(spark, str(folder), name, tmp_path, header="Id,v,n", on_error="quarantine")
    assert content(spark, name) == [(1, "a", 1.0)]
    assert [r["attempt"] for r in spark.table(name + pipelines.REJECTS_SUFFIX).collect()] == [f"{tmp_path / 'checkpoint'}:0"]


def test_a_file_with_another_header_stops_the_stream(spark, name, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("Id,n,v\n1,1,a\n")
    with pytest.raises(Exception):
        run(spark, str(folder), name, tmp_path, header="Id,v,n")
    assert content(spark, name) == []


def test_streams_merge_late_columns(spark, name, tmp_path):
    folder = tmp_path / "in.jsonl"
    folder.mkdir()
    (folder / "a.jsonl").write_text(lines([{"Id": 1, "v": "a"}, {"Id": 2, "w": "x"}]))
    run(spark, str(folder), name, tmp_path, late="merge")
    (folder / "b.jsonl").write_text(lines([{"Id": 1, "u": "y"}]))
    run(spark, str(folder), name, tmp_path, policy="update", late="merge")
    assert spark.table(name).columns == ["Id", "v", "n", "w", "u"]
    assert content(spark, name) == [(1, "a", None, None, "y"), (2, None, None, "x", None)]


def test_streams_need_a_known_format(spark, name, tmp_path):
    with pytest.raises(NotImplementedError):
        run(spark, str(tmp_path / "a.xml"), name, tmp_path)
    with pytest.raises(ValueError, match="header"):
        run(spark, str(tmp_path / "a.csv"), name, tmp_path)
