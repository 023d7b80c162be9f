"""CSV reader: one physical line is one record, and a quote may open anywhere in a cell.

With `multiline`, line ends within quotes belong to their cell: the number of quotes before a split tells whether it begins
within them, so that files are still cut anywhere.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions import cells
from tabflow.operators.transform import Raw
from tabflow.runtime import ORD, col, file_order, first_and_largest_file, scratch_dir
from tabflow.sources.cuts import before, joined_parts, with_states
from tabflow.sources.rows import places

# A separator and a quote that no text holds, so that Spark's CSV source hands over whole lines.
_NO_SEPARATOR = "\u0001\u001f\u0002\u001f\u0001"
_NO_QUOTE = "\uffff"


def _encoding(spark: SparkSession, file: str) -> str:
    """UTF-8, or what the file's byte order mark says; only its first line is looked at."""
    first = spark.read.text(file).select(F.substring(F.col("value").cast("binary"), 1, 2).alias("v")).take(1)
    return {b"\xfe\xff": "UTF-16BE", b"\xff\xfe": "UTF-16LE"}.get(bytes(first[0]["v"]) if first else b"", "UTF-8")


def _header_line(spark: SparkSession, file: str, encoding: str) -> str:
    lines = spark.read.text(file) if encoding == "UTF-8" else _decoded_lines(spark, file, encoding)
    first = lines.select("value").take(1)
    line = first[0]["value"].removeprefix("\ufeff") if first else ""
    if not line.strip():
        raise ValueError(f"CSV without a header line: {file}")
    return line


def _decoded_lines(spark: SparkSession, path, encoding: str) -> DataFrame:
    """Lines of files in UTF-16. Such files do not split at bytes, so each is one task's."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    text = F.regexp_replace(F.decode("content", encoding), "^\ufeff", "")
    lines = files.select(F.posexplode(F.split(text, "\r\n|\n|\r")).alias("m", "value"), F.col("path").alias("f"))
    order = F.struct("f", F.lit(0).cast("bigint").alias("b"), F.col("m").cast("bigint").alias("m"))
    return lines.select("value", order.alias(ORD))


def _lines_below(spark: SparkSession, path, header: str, encoding: str) -> DataFrame:
    lines = _decoded_lines(spark, path, encoding)
    bad = F.raise_error(F.concat(F.lit("another header in "), F.col(ORD)["f"])).cast("boolean")
    ours = F.when(F.col(ORD)["m"] > 0, True).when(F.col("value") == header, False).otherwise(bad)
    return lines.filter(ours).select(F.col("value").alias("line"), ORD).filter(~cells.is_blank(F.col("line")))


def line_reader(reader, header: str):
    """A reader, of files or of a stream of them, that gives whole lines below each file's own header.

    The scan splits large files, drops each file's own header and fails on a file whose header is another one.
    """
    schema = T.StructType([T.StructField(header, T.StringType())])
    return (
        reader.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("sep", _NO_SEPARATOR)
        .option("quote", _NO_QUOTE)
        .option("escape", _NO_QUOTE)
        .option("mode", "FAILFAST")
    )


def read_lines(spark: SparkSession, path, header: str) -> DataFrame:
    """Data lines below the header of every file, in file order, blank ones left out."""
    lines = line_reader(spark.read, header).csv(path)
    return lines.select(col(header).alias("line"), file_order().alias(ORD)).filter(~cells.is_blank(F.col("line")))


def header_names(spark: SparkSession, header: str) -> list[str]:
    """Column names of a header line."""
    split = spark.range(1).select(F.explode(cells.csv_split(F.lit(header))).alias("cell"))
    return [r["name"] for r in split.select(cells.csv_unquote(F.col("cell")).alias("name")).collect()]


def cells_of(lines: DataFrame, names: list[str]) -> Raw:
    """Text columns of data lines (value, order), see `read_csv`."""
    value, order = (col(c) for c in lines.columns)
    place = {name: i for i, name in enumerate(names)}
    split = lines.filter(~cells.is_blank(value)).select(cells.csv_split(value).alias("c"), order.alias(ORD))
    columns = [
        F.coalesce(cells.csv_unquote(F.get(F.col("c"), F.lit(i))), F.lit("")).alias(name)
        for name, i in place.items()
    ]
    return Raw(split.select(*columns, ORD), list(place))


def _records(header: str):
    """Staged (f, b, m, value, opens) of lines (value, order, quoted): records, and parts of those that enter or leave a
    split, told by `opens`."""
    kind = pa.schema([("f", pa.string()), ("b", pa.int64()), ("m", pa.int64()), ("value", pa.string()), ("opens", pa.bool_())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(places(batch), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (f, b), group in itertools.groupby(lines(batches), key=lambda x: x[0][:2]):
            text: list[str] = []
            quoted = head = None
            for place, line, begun in group:
                if quoted is None:
                    quoted = head = bool(begun)
                    if b == 0:
                        if line.removeprefix("\ufeff").removesuffix("\r") != header:
                            raise ValueError(f"another header in {f}")
                        continue
                first = first if text else place
                text.append(line)
                quoted ^= line.count('"') % 2 == 1
                if not quoted:
                    yield (*first, "\n".join(text).removesuffix("\r"), False if head else None)
                    text, head = [], False
            if text:
                yield (*first, "\n".join(text), not head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in itertools.batched(records(batches), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind, strict=True)], schema=kind)

    return run


_RECORD = "f string, b bigint, m bigint, value string, opens boolean"


def _multiline_records(spark: SparkSession, path, header: str) -> tuple[DataFrame, str]:
    """(value, order) of records that may hold line ends, and the folder that holds them."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", file_order().alias(ORD))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per_split = lines.groupBy(F.col(ORD)["f"].alias("f"), F.col(ORD)["b"].alias("b")).agg(F.sum(quotes).alias("quotes"))
    states = per_split.select("f", "b", (before(F.col("quotes")) % 2).alias("quoted"))
    folder = scratch_dir(spark, "records")
    with_states(lines, states).mapInArrow(_records(header), _RECORD).write.parquet(folder)
    found = spark.read.schema(_RECORD).parquet(folder)
    # A file that ends within quotes leaves a part without an end: it is the last record.
    joined = joined_parts(found.filter("opens IS NOT NULL"), "\n").withColumn("value", F.regexp_replace("value", "\r$", ""))
    records = found.filter("opens IS NULL").select("f", "b", "m", "value").unionByName(joined)
    return records.select("value", F.struct("f", "b", "m").alias(ORD)), folder


def read_csv(spark: SparkSession, path, extra: list[str] | None = None, multiline: bool = False) -> Raw:
    """Text columns of a CSV file or a folder of files with one common header.

    With `multiline` a line end within quotes is text; lines end with LF or CRLF, files are UTF-8, and the header is one
    line. Else a record is a physical line. Short rows are padded with `''`, surplus cells dropped; of columns with the same name the last one counts, at the
    place of the first. Every row has every column, so `extra` has no effect here.
    """
    file = first_and_largest_file(spark, path)[0]
    encoding = _encoding(spark, file)
    header = _header_line(spark, file, encoding)
    if multiline:
        if encoding != "UTF-8":
            raise ValueError("cells with line ends are read from UTF-8 files only")
        header = header.removesuffix("\r")
        records, folder = _multiline_records(spark, path, header)
        raw = cells_of(records, header_names(spark, header))
        return Raw(raw.df, raw.columns, staging=(folder,))
    lines = read_lines(spark, path, header) if encoding == "UTF-8" else _lines_below(spark, path, header, encoding)
    return cells_of(lines, header_names(spark, header))
