"""Per-cell rules: what parses as what, conversion, rendering, CSV grammar, XML names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabflow.functions import cells
from tabflow.functions.workbook import number_text
from tabflow.operators.infer import infer_types
from tabflow.operators.transform import Raw, transform
from tabflow.runtime import ORD
from tabflow.types import LogicalType as L
from tabflow.types import Policy, ensure_key

D = "d85b1407-351d-4694-9392-03acc5870eb1"


def raw_of(spark, **columns):
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    return Raw(df.withColumn(ORD, F.struct(F.lit(0).alias("m"))), list(columns))


CASES = [
    (["1", "-2", " 3 ", "", None], L.LONG),
    (["1", "2.5"], L.DOUBLE),
    (["9223372036854775807", "-9223372036854775808"], L.LONG),
    (["9223372036854775808"], L.DOUBLE),
    (["1,234.5"], L.DOUBLE),
    (["1.5d"], L.STRING),
    (["2f"], L.STRING),
    (["1e5", ".5", "5.", "-1E-3"], L.DOUBLE),
    (["NaN", "-infinity", "1"], L.DOUBLE),
    (["(5)", "5-", "¤7"], L.DOUBLE),
    (["."], L.STRING),
    (["1 2"], L.STRING),
    (["true", "FALSE", " True "], L.BOOL),
    (["1", "0"], L.LONG),
    (["true", "1"], L.STRING),
    (["t", "f"], L.STRING),
    ([D, D.replace("-", ""), "{" + D.upper() + "}", f"({D})"], L.UUID),
    (["{0xd85b1407,0x351d,0x4694,{0x93,0x92,0x3,0xac,0xc5,0x87,0xe,0xb1}}"], L.UUID),
    (["12345678901234567890123456789012"], L.UUID),
    (["12345678901234567890123456789012", "1.5"], L.DOUBLE),
    ([D, "x"], L.STRING),
    (["2025-10-15", "2025-10-15T14:30:00", "10/15/2025", "2025-10-15 14:30:00.1234567"], L.DATETIME),
    (["October 15, 2025", "15 Oct 2025 2:30 PM", "Wed, 15 Oct 2025 14:30:00 GMT", "2025/1/5"], L.DATETIME),
    (["2025-10-15T14:30:00Z", "2025-10-15T14:30:00+02:00"], L.DATETIME),
    (["2025-02-30"], L.STRING),
    (["13/13/2025"], L.STRING),
    (["2025-01-02|||"], L.STRING),
    (["1-2-3"], L.STRING),
    (["14:30"], L.STRING),
    (["2025"], L.LONG),
    (["2025", "2025-01-01"], L.STRING),
    (["", "  ", "\u00a0\u2003", None], L.STRING),
]


@pytest.mark.parametrize("probe_rows", [0, 1, 1000])
def test_inference(spark, probe_rows):
    width = max(len(values) for values, _ in CASES)
    columns = {f"c{i}": values + [None] * (width - len(values)) for i, (values, _) in enumerate(CASES)}
    raw = raw_of(spark, **columns)
    found = infer_types(raw.df, raw.columns, probe_rows)
    assert found == {f"c{i}": expected for i, (_, expected) in enumerate(CASES)}


def test_inference_without_rows_or_columns(spark):
    raw = raw_of(spark, a=["1"])
    assert infer_types(raw.df.filter("a = '2'"), ["a"]) == {"a": L.STRING}
    assert infer_types(raw.df, []) == {}


CONVERSIONS = [
    (cells.to_long, " +5 ", 5),
    (cells.to_long, "1,000", None),
    (cells.to_int, "3000000000", None),
    (cells.to_double, "1,234.5", 1234.5),
    (cells.to_double, "1e400", float("inf")),
    (cells.to_double, "-Infinity", float("-inf")),
    (cells.to_double, "(5)", None),
    (cells.to_double, "5-", None),
    (cells.to_bool, " TRUE ", True),
    (cells.to_bool, "false", False),
    (cells.to_bool, "1", None),
    (cells.to_guid, " {" + D.upper() + "} ", D),
    (cells.to_guid, D.replace("-", ""), D),
    (cells.to_guid, "{0xd85b1407,0x351d,0x4694,{0x93,0x92,0x3,0xac,0xc5,0x87,0xe,0xb1}}", D),
    (cells.to_datetime, "2025-10-15T14:30:00.1234567", dt.datetime(2025, 10, 15, 14, 30, 0, 123456)),
    (cells.to_datetime, "10/15/2025 2:30 PM", dt.datetime(2025, 10, 15, 14, 30)),
    (cells.to_datetime, "10/15/2025 12:30 am", dt.datetime(2025, 10, 15, 0, 30)),
    (cells.to_datetime, "2025-10-15 14:30 PM", None),
    (cells.to_datetime, "2025-10-15T14:30:00+02:00", dt.datetime(2025, 10, 15, 12, 30)),
    (cells.to_datetime, "2025-10-15 14:30:00 -0130", dt.datetime(2025, 10, 15, 16, 0)),
    (cells.to_datetime, "Dec 1, 2025", dt.datetime(2025, 12, 1)),
    (cells.to_datetime, "2025-10", dt.datetime(2025, 10, 1)),
    (cells.to_datetime, "October 2025", dt.datetime(2025, 10, 1)),
    (cells.to_datetime, "2025-13", None),
    (cells.to_datetime, "Wed, 15 Oct 2025 14:30:00 GMT", dt.datetime(2025, 10, 15, 14, 30)),
]


def test_conversions(spark):
    df = spark.createDataFrame([tuple(text for _, text, _ in CONVERSIONS)], [f"c{i}" for i in range(len(CONVERSIONS))])
    row = df.select(*[f(F.col(f"c{i}")).alias(f"c{i}") for i, (f, _, _) in enumerate(CONVERSIONS)]).first()
    assert list(row) == [expected for _, _, expected in CONVERSIONS]


def test_cell_that_infers_but_does_not_convert_aborts(spark):
    raw = raw_of(spark, Id=["1", "2"], x=["1", "(5)"])
    types = infer_types(raw.df, raw.columns)
    assert types["x"] is L.DOUBLE
    with pytest.raises(Exception, match="not a valid double"):
        transform(raw, types).collect()


def test_render(spark):
    numbers = [20.0, 0.1, -2.5, 1e7, 123456789.125, 1e14, 1e15, 1.5e300, 1e-4, 1e-5, 0.0, float("nan"), float("-inf")]
    texts = ["20", "0.1", "-2.5", "10000000", "123456789.125", "100000000000000", "1E+15", "1.5E+300", "0.0001",
             "1E-05", "0", "NaN", "-Infinity"]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r[0] for r in df.select(cells.render_number(F.col("x"))).collect()] == texts
    assert [number_text(x) for x in numbers] == texts
    row = spark.sql("SELECT true AS b, TIMESTAMP_NTZ'2025-10-15 14:30:00.9' AS t").select(
        cells.render(F.col("b"), L.BOOL), cells.render(F.col("t"), L.DATETIME)
    ).first()
    assert list(row) == ["True", "2025-10-15 14:30:00"]


def test_rendered_numbers_parse_back(spark):
    rng = random.Random(7)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 18) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    bad = df.filter(cells.to_double(cells.render_number(F.col("x"))) != F.col("x"))
    assert bad.count() == 0
    assert all(float(number_text(v)) == v for v in values)


def model_split(line):
    """The CSV grammar, a character at a time."""
    out, cell, inside, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if inside and line[i + 1 : i + 2] == '"':
                cell += '"'
                i += 1
            else:
                inside = not inside
        elif c == "," and not inside:
            out.append(cell)
            cell = ""
        else:
            cell += c
        i += 1
    return out + [cell]


def test_csv_grammar_against_model(spark):
    rng = random.Random(11)
    lines = ["".join(rng.choice('ab ,"') for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    lines += ['1,x,y,"q ""z"", w"', '4,ab"c,d"e,f', '5,"unterminated,z', ",,,", '6," lead ",t ,', "a" * 200_000 + ',"' + "b," * 50_000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = (
        df.select("i", F.posexplode(cells.csv_split(F.col("line"))).alias("p", "c"))
        .select("i", "p", cells.csv_unquote(F.col("c")).alias("c"))
        .groupBy("i").agg(F.sort_array(F.collect_list(F.struct("p", "c"))).alias("cells"))
    )
    for row in got.collect():
        assert [c["c"] for c in row["cells"]] == model_split(lines[row["i"]]), lines[row["i"]][:100]


def test_csv_escape_inverts_split(spark):
    texts = ["", "plain", "a,b", 'say "x"', '"', ",", 'a"",b', "ünï"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    line = F.concat_ws(",", cells.csv_escape(F.col("t")), F.lit("end"))
    back = df.select("t", cells.csv_split(line).alias("c")).select("t", cells.csv_unquote(F.get("c", F.lit(0))))
    assert all(a == b for a, b in back.collect())


@pytest.mark.parametrize(
    "name, expected",
    [("Full Name", "FullName"), ("1st", "_1st"), ("Имя", "Column"), ("  ", "UnknownColumn"), ("a_b", "a_b")],
)
def test_xml_name(name, expected):
    assert cells.xml_name(name) == expected


def test_policy_and_key_names():
    assert Policy.of(None) is Policy.FAIL
    assert Policy.of("Update") is Policy.UPDATE
    assert Policy.of("Игнорировать") is Policy.IGNORE
    with pytest.raises(ValueError):
        Policy.of("replace")
    assert list(ensure_key({"a": L.LONG})) == ["Id", "a"]
    assert list(ensure_key({"a": L.LONG, "ID": L.LONG})) == ["a", "ID"]
