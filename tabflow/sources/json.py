"""JSON reader for documents that are an array of objects, split between the objects.

Where all objects of a file are a like gap apart, as serializers write them, the scan cuts there. Other files are cut at
their braces, and the depth and quoting at which each split begins tell which of the braces end an object of the array.

Cells keep the text of the document: strings are unescaped, numbers and nested values stay as they are written, null is
blank, booleans are `True` and `False`. Spark's own parser re-renders such values, so the objects are parsed by a strict
parser in the tasks.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.operators.transform import Raw
from tabflow.runtime import ORD, file_order, first_and_largest_file
from tabflow.sources.cuts import before, with_states
from tabflow.sources.rows import Parsed, Stage, file_of, part_of, places, read_staged, reading_on, staged

_SPACE = re.compile(r"[ \t\n\r]*")
_MARKS = re.compile(r'\\.|["\[\]{}]', re.S)
_BETWEEN = re.compile(r'\s*,\s*\{\s*"(?:[^"\\]|\\.)+"')
#: What may still become such a gap: its first name goes on behind a brace.
_BEGUN = re.compile(r'\s*,\s*\{\s*"(?:[^"\\]|\\.)*', re.S)
_ESCAPED = re.compile(r"\\.", re.S)
#: Characters of a piece that is parsed as one; a longer one shows that its file is not cut between its objects.
_LONG = 1 << 23

# --- parsing --------------------------------------------------------------------------------------------------


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


def _scanner():
    """Passes over a value, which is never converted; made in the task, since it cannot travel there."""
    return json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_refuse).scan_once


def _skip(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _object(text: str, at: int, scan) -> tuple[dict[str, str], int]:
    """Members of the object that opens before `at`, and the place behind it. Of a repeated name the last counts."""
    row: dict[str, str] = {}
    at = _skip(text, at)
    if text[at] == "}":
        return row, at + 1
    while True:
        if text[at] != '"':
            raise ValueError("a name was expected")
        name, at = scanstring(text, at + 1)
        at = _skip(text, at)
        if text[at] != ":":
            raise ValueError("a colon was expected")
        at = _skip(text, at + 1)
        if text[at] == '"':
            row[name], at = scanstring(text, at + 1)
        else:
            value, end = scan(text, at)
            row[name] = "" if value is None else str(value) if isinstance(value, bool) else text[at:end]
            at = end
        at = _skip(text, at)
        if text[at] == "}":
            return row, at + 1
        if text[at] != ",":
            raise ValueError("a comma was expected")
        at = _skip(text, at + 1)


def _objects(text: str) -> Iterator[dict[str, str]]:
    """Rows of one whole document."""
    scan = _scanner()
    at = _skip(text, 0)
    if text[at:].rstrip() == "null":
        return
    if text[at] != "[":
        raise ValueError("the root is not an array")
    at = _skip(text, at + 1)
    if text[at] == "]":
        at += 1
    else:
        while True:
            if text[at] != "{":
                raise ValueError("an element of the array is not an object")
            row, at = _object(text, at + 1, scan)
            yield row
            at = _skip(text, at)
            if text[at] == "]":
                at += 1
                break
            if text[at] != ",":
                raise ValueError("a comma was expected")
            at = _skip(text, at + 1)
    if _skip(text, at) != len(text):
        raise ValueError("there is more text behind the array")


_ERRORS = (ValueError, IndexError, StopIteration, RecursionError)


def rows_of(text: str) -> Iterator[dict[str, str]]:
    try:
        yield from _objects(text)
    except _ERRORS as e:
        raise ValueError(f"malformed JSON: {e or 'unexpected end'}") from None
    except RuntimeError as e:  # what a generator makes of StopIteration
        raise ValueError("malformed JSON: a value was expected") from e


def _parse_piece(piece: str, lead: str) -> tuple[list[dict[str, str]], bool, bool, str | None]:
    """Rows of a piece after giving back what the cuts took; a piece that opens its document starts with a bracket."""
    piece = piece.removeprefix("\ufeff")
    start = piece[_skip(piece, 0) :][:4]
    opens = start[:1] == "[" or start == "null"
    if len(piece) > _LONG:
        return [], opens, False, "a long piece"
    text = piece if opens else "[" + lead + piece
    error = None
    for closes, end in ((False, "}]"), (True, "")):
        try:
            return list(rows_of(text + end)), opens, closes, None
        except ValueError as e:
            error = str(e)
    return [], opens, False, error


def _pieces_parser(lead: str):
    def parse(batch: pa.RecordBatch) -> Iterable[Parsed]:
        for place, piece in zip(places(batch), batch.column(0).to_pylist(), strict=True):
            yield place, *_parse_piece(piece, lead), None

    return parse


def _parse_documents(batch: pa.RecordBatch) -> Iterable[Parsed]:
    for place, text in zip(places(batch), batch.column(0).to_pylist(), strict=True):
        yield place, rows_of(text.removeprefix("\ufeff")), True, True, None, None


# --- cutting --------------------------------------------------------------------------------------------------


def _first_gap(pieces: Iterator[str]) -> tuple[bool, str | None]:
    """Text from the brace that ends the first object to the first name of the second, from pieces cut at braces."""
    depth, quoted = 0, False
    for piece in pieces:
        for mark in _MARKS.finditer(piece + "}"):
            sign = mark.group()
            if sign == '"':
                quoted = not quoted
            elif not quoted and len(sign) == 1:
                depth += 1 if sign in "[{" else -1
        if not quoted and depth == 1:
            break
    else:
        return False, None
    after = ""
    for piece in pieces:
        after += piece + "}"
        if between := _BETWEEN.match(after):
            return True, "}" + between.group()
        if not _BEGUN.fullmatch(after):
            return True, None
    return False, None


def _gap(spark: SparkSession, path: str) -> str | None:
    """The gap between the first two objects of a file, found by one task that reads on from its start until it is there.

    This text cannot occur inside a string, where a quote is escaped; it may occur in a nested array of like objects.
    """
    return reading_on(spark.read.option("lineSep", "}").text(path), _first_gap)


def _files_by_gap(spark: SparkSession, path, gap: str) -> tuple[list[str], list[str]]:
    """Files, as the scan names them, that a gap cuts into short pieces, and those with stretches where it does not occur.

    A stretch goes on through splits without the gap; it takes part in no piece, which a task would hold as one text.
    """
    begins = gap[1:].partition("}")[0]
    f, b = F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")
    per_split = spark.read.option("lineSep", "}").text(path).groupBy(f, b).agg(
        F.count_if(F.col("value").startswith(begins)).alias("n"), F.sum(F.length("value") + 1).alias("size")
    )
    runs = per_split.withColumn("since", before(F.col("n"))).groupBy("f", "since", F.col("n") > 0).agg(
        (F.sum("size") > _LONG * (F.sum("n") + 1)).alias("long")
    )
    found = runs.groupBy("f").agg(F.bool_or("long").alias("long")).collect()
    return [r["f"] for r in found if not r["long"]], [r["f"] for r in found if r["long"]]


def _pieces(spark: SparkSession, path, gap: str) -> DataFrame:
    return spark.read.option("lineSep", gap).text(path).select("value", file_order().alias(ORD))


def _documents(spark: SparkSession, path) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).filter("_metadata.file_size > 0")
    return docs.select("value", file_order().alias(ORD))


# --- cutting by depth -----------------------------------------------------------------------------------------


def _outside(piece: str, quoted: int) -> tuple[str, int]:
    """What stands outside of quotes in a piece, and whether it ends within them."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    return "".join(parts[quoted::2]), (quoted + len(parts) - 1) % 2


def _depth(outside: str) -> int:
    return outside.count("{") + outside.count("[") - outside.count("]")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(file, split) with its pieces (place, piece, states...), which come one after the other."""

    def pieces() -> Iterator[tuple]:
        for batch in batches:
            states = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)]
            yield from zip(places(batch), batch.column(0).to_pylist(), *states, strict=True)

    return itertools.groupby(pieces(), key=lambda x: x[0][:2])


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to the state: to the quoting, and to the depth if it begins outside of quotes or within."""
    for (f, b), pieces in _runs(batches):
        quoted, depth = [0, 1], [0, 0]
        for _, piece in pieces:
            for begun in (0, 1):
                outside, quoted[begun] = _outside(piece, quoted[begun])
                depth[begun] += _depth(outside) - (not quoted[begun])  # the brace that the cut took
        yield pa.RecordBatch.from_pydict({"f": [f], "b": [b], "quotes": [quoted[0]], "out": [depth[0]], "within": [depth[1]]})


def _states(pieces: DataFrame) -> DataFrame:
    """(f, b, quoted, depth): the state that each split begins with."""
    changes = pieces.mapInArrow(_changes, "f string, b bigint, quotes bigint, out bigint, within bigint")
    quoted = changes.withColumn("quoted", (before(F.col("quotes")) % 2).cast("int"))
    change = F.when(F.col("quoted") == 0, F.col("out")).otherwise(F.col("within"))
    return quoted.withColumn("change", change).select("f", "b", "quoted", before(F.col("change")).alias("depth"))


def _parse_element(place: tuple, text: str) -> Parsed:
    """A row with what stands between it and the row before, or what stands behind the last row."""
    text = text.removeprefix("\ufeff")
    at = _skip(text, 0)
    try:
        if text[at : at + 1] == "[":
            return place, list(rows_of(text + "]")), True, False, None, None
        if text[at : at + 1] == ",":
            rows = list(rows_of("[" + text[at + 1 :] + "]"))
            if len(rows) == 1:
                return place, rows, False, False, None, None
        return place, [], False, False, "a comma was expected", None
    except ValueError as e:
        return place, [], False, False, str(e), None


def _parse_elements(batch: pa.RecordBatch) -> Iterable[Parsed]:
    for place, text in zip(places(batch), batch.column(0).to_pylist(), strict=True):
        yield _parse_element(place, text)


def _parse_end(place: tuple, text: str) -> Parsed:
    """What stands behind the last row of a document, or a document without rows."""
    text = text.removeprefix("\ufeff").strip(" \t\n\r")
    if text in ("]", "null") or (text[:1] == "[" and text[1:].strip(" \t\n\r") == "]"):
        return place, [], text != "]", True, None, None
    return place, [], False, False, "the array does not end", None


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Staged lines of pieces with the state of their split: rows, and parts of those that leave or enter the split."""

    def lines() -> Iterator[tuple]:
        for _, pieces in _runs(batches):
            text: list[str] = []
            inside = head = first = None
            for place, piece, begun, start in pieces:
                if inside is None:
                    quoted, depth = begun, start
                    inside = head = depth > 1 or quoted == 1
                outside, quoted = _outside(piece, quoted)
                depth += _depth(outside)
                first = place if not text else first
                if not quoted and depth < 1:
                    yield from _lines_of(_parse_end(place, "".join(text) + piece))
                    text, inside, head = [], False, False
                    continue
                depth -= not quoted
                text.append(piece + "}")
                if quoted or depth > 1:
                    continue
                whole, text = "".join(text), []
                if head:
                    yield part_of(first, False, whole)
                else:
                    yield from _lines_of(_parse_element(first, whole))
                head = False
            if text:
                yield part_of(first, not head, "".join(text))

    return staged(lines())


def _lines_of(found: Parsed) -> Iterator[tuple]:
    place, rows, opens, closes, error, root = found
    yield (*place, -1, None, None, opens, closes, error, root, None)
    for p, row in enumerate(rows):
        yield (*place, p, list(row), list(row.values()), None, None, None, None, None)


def _by_depth(spark: SparkSession, path) -> Stage:
    pieces = spark.read.option("lineSep", "}").text(path).select("value", file_order().alias(ORD))
    stage = Stage(with_states(pieces, _states(pieces)), None, "json", run=_cut)
    return stage.completed(_parse_elements, "json")


def read_json(spark: SparkSession, path, extra: list[str] | None = None) -> Raw:
    """Text columns of JSON array documents.

    The columns are the names of the first object; `extra` adds names that later objects may carry. Files where the gap
    between the first two objects of the largest file also separates all others are split there by the scan; other
    files are split by depth, in two passes. Files without that gap are not read by it: they would be one piece. Text that is not one array of objects per file aborts.
    """

    def by_gap(files: list[str] | None, _):
        gap = _gap(spark, first_and_largest_file(spark, path)[1])
        cut, left = _files_by_gap(spark, path, gap) if gap else ([], [])
        if not cut:
            return None
        pieces = _pieces(spark, [file_of(f) for f in cut] if left else path, gap)
        return Stage(pieces, _pieces_parser(gap[gap.index("{") :]), "json").leaving(left)

    def by_depth(files: list[str] | None, _):
        return _by_depth(spark, files or path)

    def whole(files: list[str] | None, _):
        # What is left is malformed; the parser of documents says where.
        return Stage(_documents(spark, files or path), _parse_documents, "json")

    return read_staged(spark, [by_gap, by_depth, whole]).raw(extra)
