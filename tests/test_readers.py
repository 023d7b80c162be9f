"""Readers and writers: edge cases of each format and round trips."""

import io
import json
import zipfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabflow.functions.workbook import header_and_rows, write_workbook
from tabflow.operators.infer import infer_types
from tabflow.operators.transform import late_keys, transform
from tabflow.runtime import LATE, ORD
from tabflow.sinks.xlsx import write_xlsx
from tabflow.sources import formats
from tabflow.sources import json as json_source
from tabflow.sources import rows as rows_source
from tabflow.sources import xml as xml_source
from tabflow.sources.csv import read_csv
from tabflow.sources.json import read_json
from tabflow.sources.rows import reading_on
from tabflow.sources.xlsx import read_xlsx
from tabflow.sources.xml import read_xml
from tabflow.types import LogicalType as L


def rows(raw):
    return [tuple(r) for r in raw.df.orderBy(ORD).select(*[f"`{c}`" for c in raw.columns]).collect()]


# --- CSV


@pytest.mark.parametrize("bom", ["", "\ufeff"])
@pytest.mark.parametrize("eol", ["\n", "\r\n", "\r"])
def test_csv_rows(spark, file, bom, eol):
    lines = [
        "Id,a,a,b", '1,x,y,"q ""z"", w"', "", " \t\u3000", "2,only", "3,1,2,3,4,5", '4,ab"c,d"e,f',
        '5,"unterminated,z', ",,,", '6," lead ",t ,', "Id,a,a,b",
    ]
    raw = read_csv(spark, file("a.csv", bom + eol.join(lines) + eol))
    assert raw.columns == ["Id", "a", "b"]
    assert rows(raw) == [
        ("1", "y", 'q "z", w'), ("2", "", ""), ("3", "2", "3"), ("4", "f", ""), ("5", "", ""), ("", "", ""),
        ("6", "t ", ""), ("Id", "a", "b"),
    ]


def test_csv_header_errors(spark, file):
    with pytest.raises(ValueError, match="header"):
        read_csv(spark, file("blank.csv", "  \n1,2\n"))
    with pytest.raises(ValueError):
        read_csv(spark, file("empty.csv", ""))
    with pytest.raises(ValueError, match="case"):
        read_csv(spark, file("case.csv", "id,Id\n1,2\n"))


def test_csv_quoted_header_and_dots(spark, file):
    raw = read_csv(spark, file("h.csv", '"a,b",c.d,`e\n1,2,3\n'))
    assert raw.columns == ["a,b", "c.d", "`e"]
    assert [tuple(r) for r in raw.df.drop(ORD).collect()] == [("1", "2", "3")]


def test_csv_folder_keeps_file_order_and_checks_headers(spark, file, tmp_path):
    file("f.csv/b.csv", "Id,v\n3,c\n4,d\n")
    file("f.csv/a.csv", "Id,v\n1,a\n2,b\n")
    assert rows(read_csv(spark, str(tmp_path / "f.csv"))) == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]
    file("f.csv/c.csv", "Id,w\n5,e\n")
    with pytest.raises(Exception, match="header"):
        rows(read_csv(spark, str(tmp_path / "f.csv")))


def test_csv_order_over_many_splits(spark, file):
    path = file("big.csv", "Id,v\n" + "".join(f"{i},x\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9973")
    try:
        assert [int(i) for i, _ in rows(read_csv(spark, path))] == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_written_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b,c', None, 20.0, True)], "Id long, `x,y` string, n string, d double, b boolean")
    formats.write(df.coalesce(1), str(tmp_path / "o.csv"))
    (part,) = (tmp_path / "o.csv").glob("part-*")
    assert part.read_text(encoding="utf-8") == '\ufeffId,"x,y",n,d,b\n1,"a""b,c",,20,True\n'


# --- JSON


DOCS = {
    "pretty": json.dumps([{"Id": 1, "a": 'x},{ "y'}, {"Id": 2, "a": None}, {"Id": 3}], indent=2),
    "compact": '[{"Id":1,"a":"x},{ \\"y"},{"Id":2,"a":null},{"Id":3}]',
    "lines": '[\n{"Id":1,"a":"x},{ \\"y"},\n{"Id":2,"a":null},\n{"Id":3}\n]\n',
    "uneven": '[{"Id":1,"a":"x},{ \\"y"},{"Id":2,"a":null} ,\n\n {"Id":3}]',
    "bom": '\ufeff[{"Id":1,"a":"x},{ \\"y"},{"Id":2,"a":null},{"Id":3}]',
}


@pytest.mark.parametrize("layout", DOCS)
def test_json_layouts(spark, file, layout):
    raw = read_json(spark, file("a.json", DOCS[layout]))
    assert raw.columns == ["Id", "a"]
    assert rows(raw) == [("1", 'x},{ "y'), ("2", ""), ("3", None)]


@pytest.mark.parametrize("layout", ["compact", "pretty"])
def test_json_many_splits(spark, file, layout):
    objects = [{"Id": i, "t": 'q"}, {"' + "\\" * (i % 3), "l": [{"x": i}, {"y": [i]}]} for i in range(2000)]
    indent = 2 if layout == "pretty" else None
    path = file("a.json", json.dumps(objects, indent=indent))
    # Nested values keep the document's own blanks.
    nested = [json.dumps(o["l"], indent=indent).replace("\n", "\n    ") for o in objects]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5003")
    try:
        raw = read_json(spark, path)
        assert raw.df.rdd.getNumPartitions() > 8
        assert rows(raw) == [(str(o["Id"]), o["t"], text) for o, text in zip(objects, nested)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_values(spark, file):
    raw = read_json(spark, file("a.json", '[{"Id":1,"o":{"x":1},"l":[1,2],"a":1,"a":2,"b":true,"u":"\\u00e9\\n"}]'))
    assert raw.columns == ["Id", "o", "l", "a", "b", "u"]
    assert rows(raw) == [("1", '{"x":1}', "[1,2]", "2", "True", "é\n")]


def test_json_cells_keep_their_text(spark, file):
    long = "12345678901234567890.12345678901234567890"
    raw = read_json(spark, file("a.json", f'[{{"a": 1.50, "b": {{"k": 1}}, "c": {long}, "d": false}},{{"a": -0e+1, "b": [ ], "c": null, "d": "x"}}]'))
    assert rows(raw) == [("1.50", '{"k": 1}', long, "False"), ("-0e+1", "[ ]", "", "x")]


@pytest.mark.parametrize(
    "text",
    ['[{"Id":1}][{"Id":2}]', '[{"Id":1},{"Id":2}]\n[{"Id":3},{"Id":4}]', '[{"Id":1},{"Id":2}]' * 5, "[{'Id':1}]", '[{"Id":NaN}]',
     '[{"Id":1},{"Id":Infinity}]', '[{"Id":01}]', '[{"Id":1},]', '[{"Id":1 "a":2}]', '[{"Id":1}{"Id":2}]'],
)
def test_json_refuses_what_is_not_one_array(spark, file, text):
    with pytest.raises(Exception, match="malformed JSON"):
        read_json(spark, file("a.json", text)).df.collect()


def test_json_concatenated_files_are_refused(spark, file):
    one = json.dumps([{"Id": i} for i in range(1000)])
    with pytest.raises(Exception, match="malformed JSON"):
        read_json(spark, file("a.json", one + "\n" + one)).df.collect()


def test_json_large_first_object_still_splits(spark, file):
    objects = [{"Id": 0, "t": "}" * 3000 + "x" * (1 << 21)}] + [{"Id": i, "t": "y" * 500} for i in range(1, 4000)]
    path = file("a.json", json.dumps(objects))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 19))
    try:
        raw = read_json(spark, path)
        assert raw.df.rdd.getNumPartitions() > 3
        assert rows(raw) == [(str(o["Id"]), o["t"]) for o in objects]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ["[]", " null ", "[ ]"])
def test_json_without_rows(spark, file, text):
    raw = read_json(spark, file("a.json", text))
    assert raw.columns == [] and raw.df.count() == 0


@pytest.mark.parametrize(
    "text",
    ['{"Id":1}', "  ", '[{"Id":1},{"Id":2}', '[{"Id":1},{"Id":', '[{"Id":1},null]', '[{"Id":1},{"Id":2},null]',
     '[{"Id":1},{"Id":2}] x', "[1,2]", '[{"Id":1},{"Id":tru},{"Id":3}]'],
)
def test_json_errors(spark, file, text):
    with pytest.raises(Exception):
        read_json(spark, file("a.json", text)).df.collect()


def test_json_late_keys(spark, file):
    path = file("a.json", '[{"Id":1},{"Id":2,"late":"v"},{"Id":3,"late":"w"}]')
    raw = read_json(spark, path)
    assert [tuple(r) for r in late_keys(raw).collect()] == [("late", 2)]
    with pytest.raises(Exception, match="late"):
        transform(raw, infer_types(raw.df, raw.columns)).collect()
    assert rows(read_json(spark, path, extra=["late"])) == [("1", None), ("2", "v"), ("3", "w")]


def test_json_written_text(spark, tmp_path):
    df = spark.sql(
        "SELECT 1L AS Id, 'é\"\\n' AS s, CAST(NULL AS STRING) AS n, 20.0D AS d, true AS b, "
        "TIMESTAMP_NTZ'2025-10-15 14:30:00.5' AS t UNION ALL SELECT 2L, '', 'x', 1e20D, false, NULL"
    )
    formats.write(df.coalesce(1), str(tmp_path / "o.json"))
    (part,) = (tmp_path / "o.json").glob("part-*")
    assert json.loads(part.read_text(encoding="utf-8")) == [
        {"Id": 1, "s": 'é"\n', "n": None, "d": 20, "b": True, "t": "2025-10-15T14:30:00.5"},
        {"Id": 2, "s": "", "n": "x", "d": 1e20, "b": False, "t": None},
    ]
    assert '"d":20,' in part.read_text(encoding="utf-8")


# --- XML


XML = [
    ('<r><Item k="9"><Id>1</Id><v> x </v><e/></Item></r>', ["Id", "v", "e"], [("1", " x ", "")]),
    ("<r><Item><Id>2</Id><Id>3</Id></Item></r>", ["Id"], [("3",)]),
    ("<r><Row><n>a<b>c</b>d</n></Row></r>", ["n"], [("acd",)]),
    ("<r><Row><n>a&lt;b&gt;c</n></Row><Row><n>&#65;&amp;lt;\r\n&quot;</n></Row></r>", ["n"], [("a<b>c",), ('A&lt;\n"',)]),
    ('<r xmlns:p="u"><p:Item><p:Id>1</p:Id></p:Item></r>', ["Id"], [("1",)]),
    ("<r><Item><Id>1</Id></Item><Item/><Item><Id>2</Id></Item></r>", ["Id"], [("1",), (None,), ("2",)]),
    ("<r><A><x>1</x></A><B><x>2</x></B></r>", ["x"], [("1",), ("2",)]),
    ("<r><A><x><A>1</A></x></A><A><x>2</x></A></r>", ["x"], [("1",), ("2",)]),
    ("<r><I><v><![CDATA[</I>&]]></v></I><I><v>2</v></I></r>", ["v"], [("</I>&",), ("2",)]),
    ('<?xml version="1.0"?>\n<!-- <I> -->\n<r a="x>y">\n <I b="/>"><v>1</v></I>\n</r>\n<!-- end -->', ["v"], [("1",)]),
]


@pytest.mark.parametrize("text, columns, expected", XML)
def test_xml_documents(spark, file, text, columns, expected):
    raw = read_xml(spark, file("a.xml", text))
    assert raw.columns == columns
    assert rows(raw) == expected


def test_xml_row_without_columns(spark, file):
    raw = read_xml(spark, file("a.xml", "<r><Item/></r>"))
    assert raw.columns == [] and raw.df.count() == 1
    assert read_xml(spark, file("b.xml", "<r/>")).df.count() == 0


@pytest.mark.parametrize("text", ["  ", "<r><A><x>1</x></A>", "<r><A><x>1</A></r>", "text"])
def test_xml_errors(spark, file, text):
    with pytest.raises(Exception):
        read_xml(spark, file("a.xml", text)).df.collect()


def test_xml_declared_encoding(spark, file):
    text = "<?xml version='1.0' encoding='{}'?><r><I><Id>1</Id><v>café</v></I><I><Id>2</Id><v>é</v></I></r>"
    for name in ("iso-8859-1", "windows-1252", "utf-16", "utf-8"):
        raw = read_xml(spark, file(f"{name}.xml", text.format(name).encode(name)))
        assert rows(raw) == [("1", "café"), ("2", "é")]


def test_xml_declared_entities(spark, file):
    text = '<!DOCTYPE r [<!ENTITY foo "b>r"> ]><r><I><v>1</v></I><I><v>&foo;&amp;</v></I><I><v>2</v></I></r>'
    assert rows(read_xml(spark, file("a.xml", text))) == [("1",), ("b>r&",), ("2",)]


@pytest.mark.parametrize(
    "text",
    ["<r><I><v>1</v></I><I><v>a & b</v></I></r>", "<r><I><v>1</v></I><I><v>&foo;</v></I></r>", "<r><I><v>1</v></I><I><v>2</v></I></q>",
     "<r><I><v>1</v></I></r><r><I><v>2</v></I></r>", "<r><I><v>1</v></I><I><v a=1>2</v></I></r>"],
)
def test_xml_refuses_malformed_documents(spark, file, text):
    with pytest.raises(Exception, match="malformed XML"):
        read_xml(spark, file("a.xml", text)).df.collect()


def test_names_of_files_are_no_patterns(spark, file, tmp_path):
    for extension, text in ((".csv", "Id,v\n1,a\n"), (".json", '[{"Id":1,"v":"a"}]'), (".xml", "<r><I><Id>1</Id><v>a</v></I></r>")):
        file(f"f{extension}/p[1]{{x}}{extension}", text)
        assert rows(formats.read(spark, str(tmp_path / f"f{extension}"))) == [("1", "a")]


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-be", "utf-16-le"])
def test_csv_byte_order_marks(spark, file, encoding):
    mark = {"utf-16": b"", "utf-16-be": b"\xfe\xff", "utf-16-le": b"\xff\xfe"}[encoding]
    raw = read_csv(spark, file("a.csv", mark + 'Id,näme\r\n1,"é,中"\r\n2,ž😀\r\n'.encode(encoding)))
    assert raw.columns == ["Id", "näme"]
    assert rows(raw) == [("1", "é,中"), ("2", "ž😀")]


def test_xml_late_columns(spark, file):
    path = file("a.xml", "<r><I><Id>1</Id></I><I><Id>2</Id><late>v</late></I><I><Id>3</Id><o><p/>w</o></I></r>")
    raw = read_xml(spark, path)
    assert raw.df.filter(F.size(LATE) > 0).count() == 2
    assert rows(read_xml(spark, path, extra=["late"]))[1] == ("2", "v")


def test_xml_many_splits(spark, file):
    body = "".join(f"  <Item>\n    <Id>{i}</Id>\n    <t>a&amp;{i}</t>\n  </Item>\n" for i in range(2000))
    path = file("a.xml", f"<ExportedData>\n{body}</ExportedData>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5003")
    try:
        raw = read_xml(spark, path)
        assert raw.df.rdd.getNumPartitions() > 8
        assert rows(raw) == [(str(i), f"a&{i}") for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# --- XLSX


def with_second_sheet(content):
    """The same workbook with a sheet in front in the package but second in the book."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        other = old.read("xl/worksheets/sheet1.xml").replace(b"c1", b"zz")
        new.writestr("xl/worksheets/sheet0.xml", other)
        for name in old.namelist():
            data = old.read(name)
            if name == "xl/workbook.xml":
                data = data.replace(b"</sheets>", b'<sheet name="b" sheetId="2" r:id="rId9"/></sheets>')
            if name == "xl/_rels/workbook.xml.rels":
                data = data.replace(b"</Relationships>", b'<Relationship Id="rId9" Type="x" Target="worksheets/sheet0.xml"/></Relationships>')
            new.writestr(name, data)
    return out.getvalue()


def test_xlsx_rows(spark, file):
    content = write_workbook(
        ["Id", " ", "c1", "c1"],
        [("1", "x", "old", "new"), (None, " ", None, None), ("2", None, "\x08_x0041_\r", 'q"<&')],
    )[0]
    raw = read_xlsx(spark, file("a.xlsx", with_second_sheet(content)))
    assert raw.columns == ["Id", "Column_2", "c1"]
    assert rows(raw) == [("1", "x", "new"), ("2", "", 'q"<&')]


def test_xlsx_shared_strings_and_sparse_cells(spark, file):
    sheet = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="3"><c r="C3"><v>1.5E1</v></c><c r="D3" t="b"><v>1</v></c><c r="E3" s="1"><v>45945.604166666664</v></c></row>'
        "</sheetData></worksheet>"
    )
    shared = (
        '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Id</t></si>'
        "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(write_workbook([], [])[0])) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, sheet if "sheet1" in name else old.read(name))
        new.writestr("xl/sharedStrings.xml", shared)
    assert list(header_and_rows(out.getvalue())) == [["Id", "", "rich"], ["", "", "15", "TRUE", "10/15/2025 14:30:00"]]
    assert list(header_and_rows(write_workbook([], [])[0])) == [[]]
    raw = read_xlsx(spark, file("a.xlsx", out.getvalue()))
    assert raw.columns == ["Id", "Column_2", "rich", "Column_4", "Column_5"]
    assert rows(raw) == [("", "", "15", "TRUE", "10/15/2025 14:30:00")]


def test_xlsx_header_of_another_workbook(spark, file, tmp_path):
    file("f.xlsx/a.xlsx", write_workbook(["Id", "v"], [(1, "a")])[0])
    file("f.xlsx/b.xlsx", write_workbook(["other"], [])[0])
    assert rows(read_xlsx(spark, str(tmp_path / "f.xlsx"))) == [("1", "a")]
    file("f.xlsx/c.xlsx", write_workbook(["Id"], [(2,)])[0])
    with pytest.raises(ValueError, match="differs"):
        read_xlsx(spark, str(tmp_path / "f.xlsx"))


@pytest.mark.parametrize("extension", ["json", "xml", "xlsx"])
def test_export_without_rows(spark, tmp_path, extension):
    df = spark.createDataFrame([], "Id long, v string")
    path = str(tmp_path / f"o.{extension}")
    formats.write(df, path)
    raw = formats.read(spark, path)
    assert raw.df.count() == 0
    parts = [p for p in (tmp_path / f"o.{extension}").glob("part-*") if p.stat().st_size]
    assert len(parts) == 1
    if extension == "json":
        assert json.loads(parts[0].read_text()) == []
    elif extension == "xml":
        assert "<ExportedData>" in parts[0].read_text() and "<Item>" not in parts[0].read_text()
    else:
        assert raw.columns == ["Id", "v"]


def test_xlsx_text_of_other_types(spark, tmp_path):
    df = spark.sql("SELECT 1 AS Id, CAST(1 AS FLOAT) AS f, CAST(1.50 AS DECIMAL(18,4)) AS d, DATE'2025-10-15' AS day")
    write_xlsx(df, str(tmp_path / "o.xlsx"))
    assert (tmp_path / "o.xlsx/_SUCCESS").exists() and not list((tmp_path / "o.xlsx").glob("_parts*"))
    assert rows(read_xlsx(spark, str(tmp_path / "o.xlsx")))[0][:2] == ("1", "1")


def test_xlsx_export_that_fails_leaves_no_workbook(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "if(id = 9, raise_error('boom'), 'x') AS v")
    with pytest.raises(Exception, match="boom"):
        write_xlsx(df, str(tmp_path / "o.xlsx"), rows_per_file=2)
    assert not list((tmp_path / "o.xlsx").glob("*.xlsx")) and not (tmp_path / "o.xlsx/_SUCCESS").exists()
    with pytest.raises(Exception):
        write_xlsx(spark.range(1), "nosuch://x/o.xlsx")


def test_xlsx_folder(spark, tmp_path):
    df = spark.range(25).selectExpr("id AS Id", "id % 2 = 0 AS even", "CAST(id AS DOUBLE) / 4 AS d", "CAST(id AS INT) AS i").coalesce(2)
    manifest = write_xlsx(df, f"file:{tmp_path}/o.xlsx", rows_per_file=10)
    sizes = [r["n_rows"] for r in manifest.collect()]
    assert sum(sizes) == 25 and max(sizes) <= 10
    raw = read_xlsx(spark, str(tmp_path / "o.xlsx"))
    types = infer_types(raw.df, raw.columns)
    assert types == {"Id": L.LONG, "even": L.BOOL, "d": L.DOUBLE, "i": L.LONG}
    assert sorted(map(tuple, transform(raw, types).drop(ORD).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileExistsError):
        write_xlsx(df, str(tmp_path / "o.xlsx"))


def test_unknown_format(spark):
    with pytest.raises(NotImplementedError):
        formats.read(spark, "/tmp/a.txt")


# --- files of one folder that say different things of themselves


def _many(tag: str, values, start: int) -> str:
    return "".join(f"<{tag}><Id>{start + i}</Id><v>{v}</v></{tag}>" for i, v in enumerate(values))


def _kinds(raw) -> dict[str, int]:
    """Pieces per file, by name."""
    lines = raw.df.sparkSession.read.parquet(*raw.staging).filter("names IS NULL AND error IS NULL")
    return {r["f"].rpartition("/")[2]: r["n"] for r in lines.groupBy("f").agg(F.count("*").alias("n")).collect()}


def test_xml_files_have_their_own_entities(spark, file):
    doc = '<?xml version="1.0"?><!DOCTYPE r [<!ENTITY foo "{}">]><r>{}</r>'
    file("d/a.xml", doc.format("AAA", _many("I", ["&foo;"] * 4, 1)) + "<!-- the largest -->" * 9)
    file("d/b.xml", doc.format("BBB", _many("I", ["&foo;"] * 4, 101)))
    path = file("d/c.xml", "<r>" + _many("I", ["plain"] * 3, 201) + "</r>").rpartition("/")[0]
    raw = read_xml(spark, path)
    expected = [(str(i), "AAA") for i in range(1, 5)] + [(str(i), "BBB") for i in range(101, 105)] + [(str(i), "plain") for i in range(201, 204)]
    assert rows(raw) == expected
    assert _kinds(raw)["a.xml"] >= 5 and _kinds(raw)["b.xml"] >= 5  # still cut into pieces


def test_xml_files_have_their_own_encoding(spark, file):
    latin = '<?xml version="1.0" encoding="iso-8859-1"?><r>' + _many("I", ["Ã©", "Ã©"], 1) + "</r>"
    file("d/a.xml", latin.encode("latin-1"))
    file("d/b.xml", "<r>" + _many("I", ["é"] * 9, 101) + "</r>")
    file("d/c.xml", "<r>" + _many("I", ["x", "y"], 201) + "</r>")
    path = file("d/d.xml", ('<?xml version="1.0" encoding="utf-16"?><r>' + _many("I", ["ü"], 301) + "</r>").encode("utf-16")).rpartition("/")[0]
    raw = read_xml(spark, path)
    assert rows(raw) == [("1", "Ã©"), ("2", "Ã©")] + [(str(101 + i), "é") for i in range(9)] + [("201", "x"), ("202", "y"), ("301", "ü")]
    assert _kinds(raw)["b.xml"] >= 10


def test_xml_roots_and_tags_differ_by_file(spark, file):
    file("d/a.xml", "<one>" + _many("I", ["a"] * 9, 1) + "</one>")
    file("d/b.xml", "<two>\n" + _many("I", ["b"] * 5, 101) + "\n</two>\n<!-- end -->")
    file("d/c.xml", "<three>" + _many("Other", ["c"] * 2, 201) + "</three>")
    path = file("d/d.xml", "<r><I><I>x</I></I><I><Id>302</Id></I></r>").rpartition("/")[0]
    raw = read_xml(spark, path, extra=["I"])
    got = [tuple(r) for r in raw.df.orderBy(ORD).select("Id", "v", "I").collect()]
    assert got[:9] == [(str(1 + i), "a", None) for i in range(9)] and got[9:14] == [(str(101 + i), "b", None) for i in range(5)]
    assert got[14:] == [("201", "c", None), ("202", "c", None), (None, None, "x"), ("302", None, None)]
    assert _kinds(raw)["a.xml"] >= 10 and _kinds(raw)["b.xml"] >= 6


@pytest.mark.parametrize("bad", ["<r><I><Id>1</Id></I></q>", "<r><I><Id>1</Id></I>", b"<r><I><Id>\xff</Id></I></r>", "<I><Id>1</Id></I></r>", "<r><I><Id>&none;</Id></I></r>"])
def test_xml_a_malformed_file_among_others_aborts(spark, file, bad):
    file("d/a.xml", "<r>" + _many("I", ["a"] * 9, 1) + "</r>")
    path = file("d/b.xml", bad).rpartition("/")[0]
    with pytest.raises(Exception, match="malformed XML"):
        read_xml(spark, path).df.collect()


def test_json_files_of_another_layout(spark, file):
    """Only the files that the largest file's layout does not fit are read in another way."""
    file("d/a.json", json.dumps([{"Id": i, "v": "a"} for i in range(50)]))
    file("d/b.json", json.dumps([{"Id": 100 + i, "v": "b"} for i in range(5)], indent=1))
    path = file("d/c c.json", '[{"Id":201,"v":[{"Id":1},{"Id":2}]},{"Id":202,"v":"},{"}]').rpartition("/")[0]
    raw = read_json(spark, path)
    expected = [(str(i), "a") for i in range(50)] + [(str(100 + i), "b") for i in range(5)] + [("201", '[{"Id":1},{"Id":2}]'), ("202", "},{")]
    assert rows(raw) == expected
    assert _kinds(raw)["a.json"] >= 50


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _splits(raw) -> int:
    return raw.df.sparkSession.read.parquet(*raw.staging).select("f", "b").distinct().count()


NESTED = [
    {"Id": i, "a": 'q"\\{}[]},{"Id":1' * (i % 5), "b": [{"Id": 1}, {"Id": 2, "c": {"d": "}"}}], "e": "x" * (3000 if i % 20 == 7 else i)}
    for i in range(60)
]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_json_is_cut_by_depth(small_splits, file, indent, threshold):
    """Nested objects like the rows defeat the gap; rows go on over several splits."""
    small_splits.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    path = file("a.json", json.dumps(NESTED, indent=indent))
    raw = read_json(small_splits, path)
    text = lambda v: v if isinstance(v, str) else str(v) if isinstance(v, int) else json.dumps(v, indent=indent)
    found = rows(raw)
    assert [(r[0], r[1], json.loads(r[2]), r[3]) for r in found] == [(str(r["Id"]), r["a"], r["b"], r["e"]) for r in NESTED]
    assert indent or [r[2] for r in found] == [text(r["b"]) for r in NESTED]
    assert _splits(raw) >= 10


def test_json_first_name_of_many_braces(small_splits, file):
    rows_ = [{"{}" * 40: i, "b": "y" * 50} for i in range(100)]
    raw = read_json(small_splits, file("a.json", json.dumps(rows_)))
    assert rows(raw) == [(str(i), "y" * 50) for i in range(100)] and _splits(raw) >= 6


@pytest.mark.parametrize("bad", ['[{"a":1} {"a":{"b":2}}]', '[{"a":{}},{"a":{}}', '[{"a":{}},]', '[{"a":{}},{"a":{}}]]', '[{"a":{}}],{"a":{}}', '{"a":{}}', '[[{"a":{}}]]'])
def test_json_cut_by_depth_refuses_malformed_documents(small_splits, file, bad):
    with pytest.raises(Exception, match="malformed JSON"):
        read_json(small_splits, file("a.json", bad)).df.collect()


@pytest.mark.parametrize("text", ["[]", "null", " [ ] \n", "\ufeff[]", '[{"a":1}]', '\ufeff [ {"a" : 1 } ] '])
def test_json_small_documents_by_depth(small_splits, file, text):
    from tabflow.sources.json import _by_depth

    stage = _by_depth(small_splits, file("a.json", text))
    assert stage.broken().count() == 0
    assert [tuple(r["texts"]) for r in stage.lines.filter("names IS NOT NULL").collect()] == ([("1",)] if "1" in text else [])


MULTILINE = [(i, ["", 'a\nb"c,d', "\n\n", "x\r\ny", '"', "line\n" * 700, "plain"][i % 7], i / 4) for i in range(120)]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_cells_of_several_lines(small_splits, file, threshold, end):
    small_splits.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    body = end.join(["Id,v,n"] + [f"{i},{quoted(v)},{n}" for i, v, n in MULTILINE] + ["", "  "]) + end
    raw = read_csv(small_splits, file("a.csv", "\ufeff" + body), multiline=True)
    assert rows(raw) == [(str(i), v, str(n)) for i, v, n in MULTILINE]
    assert _splits(raw) >= 4


def test_csv_multiline_round_trip_and_import(spark, database, tmp_path):
    from tabflow.plans import pipelines

    df = spark.createDataFrame([r for r in MULTILINE if r[1].strip()], "Id long, v string, n double").repartition(3)
    formats.write(df, str(tmp_path / "a.csv"), multiline=True)
    pipelines.add_table(spark, str(tmp_path / "a.csv"), f"{database}.m", multiline=True)
    assert sorted(map(tuple, spark.table(f"{database}.m").collect())) == sorted(map(tuple, df.collect()))


def test_csv_multiline_headers_and_open_ends(spark, file):
    file("d/a.csv", 'Id,v\n1,"x\ny"\n')
    path = file("d/b.csv", 'Id,v\n2,"never\nclosed').rpartition("/")[0]
    assert rows(read_csv(spark, path, multiline=True)) == [("1", "x\ny"), ("2", "never\nclosed")]
    file("d/c.csv", "Id,w\n3,z\n")
    with pytest.raises(Exception, match="another header"):
        read_csv(spark, path, multiline=True)


@pytest.mark.parametrize("extension", ["csv", "json", "jsonl", "xml", "xlsx"])
def test_one_output_file(spark, tmp_path, extension):
    df = spark.range(50).selectExpr("id AS Id", "concat('v', id) AS v").repartition(4)
    path = tmp_path / f"out.{extension}"
    formats.write(df, str(path), single_file=True)
    assert path.is_file()
    raw = formats.read(spark, str(path))
    assert sorted(rows(raw)) == sorted((str(i), f"v{i}") for i in range(50))
    with pytest.raises(ValueError, match="there is something"):
        formats.write(df, str(path), single_file=True)


def test_one_output_file_without_rows(spark, tmp_path):
    for extension, content in (("csv", ""), ("json", "[]"), ("jsonl", "")):
        path = tmp_path / f"none.{extension}"
        formats.write(spark.range(0).selectExpr("id AS Id"), str(path), single_file=True)
        assert path.read_text().strip() == content


# --- pieces and beginnings of large files


def test_json_file_without_the_gap_is_not_one_piece(spark, file, tmp_path, monkeypatch):
    """A file of another layout is not read by the gap; one that changes its layout midway is found by its long piece."""
    monkeypatch.setattr(json_source, "_LONG", 2000)
    lines = lambda ids: "\n,".join(f'{{"Id":{i},"v":"a}}b"}}' for i in ids)
    spread = lambda ids: ",".join(f'\n {{\n "Id" : {i} ,\n "v" : "c" }}' for i in ids)
    folder = str(tmp_path / "f.json")
    file("f.json/0.json", f"[{lines(range(400))}]")
    file("f.json/1.json", f"[{spread(range(400, 700))}]")
    file("f.json/2.json", f"[{lines(range(700, 800))},{spread(range(800, 1000))}]")
    file("f.json/3.json", "")
    gap = json_source._gap(spark, f"{folder}/0.json")
    cut, left = json_source._files_by_gap(spark, folder, gap)
    assert [[f[-6:] for f in sorted(x)] for x in (cut, left)] == [["0.json", "2.json"], ["1.json"]]
    assert json_source._parse_piece("x" * 2001, "{")[3] == "a long piece"
    for size in ("134217728", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = rows(read_json(spark, folder))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == [(str(i), "a}b" if i < 400 or 700 <= i < 800 else "c") for i in range(1000)]


def test_json_object_longer_than_a_piece(spark, file, monkeypatch):
    monkeypatch.setattr(json_source, "_LONG", 2000)
    texts = ["x" * 50, "}" * 9000, "y"]
    path = file("a.json", "[" + "\n,".join(json.dumps({"Id": i, "v": t}) for i, t in enumerate(texts * 20)) + "]")
    assert rows(read_json(spark, path)) == [(str(i), t) for i, t in enumerate(texts * 20)]


@pytest.mark.parametrize("where", [0, 5, 70])
def test_first_reading_goes_no_further_than_it_has_to(spark, file, monkeypatch, where):
    monkeypatch.setattr(rows_source, "_FIRST", 10)
    path = file("a.txt", "".join(f"{i}}}" for i in range(5000)))
    read = Observation()
    pieces = spark.read.option("lineSep", "}").text(path).observe(read, F.count(F.lit(1)).alias("n"))
    found = reading_on(pieces, lambda values: next(((True, f"at {v}") for v in values if int(v) >= where), (False, None)))
    assert found == f"at {where}"
    assert read.get["n"] <= 100  # of the first of its tasks


def test_first_reading_ends_with_the_file(spark, file, monkeypatch):
    monkeypatch.setattr(rows_source, "_FIRST", 2)
    path = file("a.txt", "".join(f"{i}}}" for i in range(20)))
    assert reading_on(spark.read.option("lineSep", "}").text(path), lambda values: (False, str(len(list(values))))) == "20"


@pytest.mark.parametrize("first", [1, 2, 1000])
def test_beginnings_of_json_and_xml_at_any_step(spark, file, monkeypatch, first):
    monkeypatch.setattr(rows_source, "_FIRST", first)
    wide = json.dumps({"Id": 1, "v": {f"k{i}": [{"Id": "}"}] for i in range(40)}})
    assert json_source._gap(spark, file("a.json", f'[{wide} , {{ "a}}b" : 2}}]')) == '} , { "a}b"'
    assert json_source._gap(spark, file("b.json", f"[{wide}]")) is None
    cells = "".join(f"<c{i}>x</c{i}>" for i in range(40))
    assert xml_source._row_tag(spark, file("a.xml", f"<r><row>{cells}</row></r>")) == "row"
    assert xml_source._row_tag(spark, file("b.xml", "<r></r>")) is None
    assert xml_source._row_tag(spark, file("c.xml", "<r></x>")) is None
