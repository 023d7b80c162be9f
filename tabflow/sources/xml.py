"""XML reader: the root's children are rows, their children are columns.

Files are split at the closing tag of rows. Every piece goes through an XML parser inside its task, many pieces at a
time. What a file says of itself holds for that file alone: where its rows need the entities it declares, its pieces are
parsed once more with its own document type in front; a file in another encoding than UTF-8, or with rows of other tags,
is parsed whole from its bytes, as its declaration says.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.operators.transform import Raw
from tabflow.runtime import ORD, file_order, first_and_largest_file
from tabflow.sources.rows import Parsed, Stage, places, read_staged, reading_on

_CHUNK = 1 << 20
#: Root of pieces that hold rows only; no document can close it.
_WITHIN = "_.."
_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(?:\[.*\]\s*)?>", re.S)
_ENCODING = re.compile(rb"""^<\?xml[^>]*?\sencoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")


class _Rows:
    """Rows of a document as they close; the place of each row's start tag comes with it."""

    def __init__(self, encoding: str | None = None):
        self.parser = expat.ParserCreate(encoding)
        self.parser.buffer_text = True
        self.parser.StartElementHandler = self._start
        self.parser.EndElementHandler = self._end
        self.parser.CharacterDataHandler = self._text
        self.depth, self.rows, self.row, self.cell, self.at = 0, [], {}, [], 0

    def _start(self, name: str, attributes: dict) -> None:
        self.depth += 1
        if self.depth == 2:
            self.row, self.at = {}, self.parser.CurrentByteIndex
        elif self.depth == 3:
            self.cell = []

    def _end(self, name: str) -> None:
        if self.depth == 3:
            self.row[name.rpartition(":")[2]] = "".join(self.cell)
        elif self.depth == 2:
            self.rows.append((self.at, self.row))
        self.depth -= 1

    def _text(self, text: str) -> None:
        if self.depth >= 3:
            self.cell.append(text)

    def taken(self) -> list[tuple[int, dict[str, str]]]:
        rows, self.rows = self.rows, []
        return rows


def _rows_of(text: bytes) -> list[tuple[int, dict[str, str]]]:
    found = _Rows("utf-8")
    found.parser.Parse(text, True)
    return found.taken()


def _opening(text: bytes) -> list[dict[str, str]]:
    """Rows of a document's start, which leaves its root open."""
    found = _Rows("utf-8")
    found.parser.Parse(text, False)
    if found.depth != 1:
        raise expat.ExpatError("the cut is not between rows")
    return [row for _, row in found.taken()]


def _prologue(piece: bytes) -> tuple[str, str]:
    """Name of the root, and document type, of the piece that a document begins with."""
    parser, names = expat.ParserCreate("utf-8"), []
    parser.StartElementHandler = lambda name, attributes: names.append(name)
    parser.Parse(piece, False)
    doctype = _DOCTYPE.search(piece.decode()) if b"<!DOCTYPE" in piece else None
    return names[0] if names else "", doctype.group() if doctype else ""


def _pieces_parser(tag: str, doctypes: dict[str, str]):
    """Parser of pieces that end before the closing tag of a row. doctypes: those that are known by file."""
    end = f"</{tag}>".encode()
    closing = re.compile(rb"</\s*([^\s<>/]+)\s*>(?:\s|<!--.*?-->|<\?.*?\?>)*$", re.S)

    def parse_together(pieces: list[bytes], head: bytes) -> list[list[dict[str, str]]]:
        """Rows of pieces of one file that hold nothing but rows, in one pass."""
        parts = [p + end for p in pieces]
        starts, at = [], len(head)
        for p in parts:
            starts.append(at)
            at += len(p)
        out: list[list[dict[str, str]]] = [[] for _ in pieces]
        for place, row in _rows_of(head + b"".join(parts) + f"</{_WITHIN}>".encode()):
            out[bisect_right(starts, place) - 1].append(row)
        return out

    def parse_alone(piece: bytes, doctype: str) -> tuple[list[dict[str, str]], bool, bool, str | None, str | None]:
        try:
            piece.decode()
            if _other_encoding(piece):
                return [], False, False, "another encoding", None
            last = closing.search(piece)
            forms = [(lambda: _opening(piece + end), True, False)]
            if last:
                root = last.group(1).decode()
                forms += [
                    (lambda: [row for _, row in _rows_of(f"{doctype}<{root}>".encode() + piece)], False, True),
                    (lambda: [row for _, row in _rows_of(piece)], True, True),
                ]
            else:
                forms += [(lambda: [row for _, row in _rows_of(piece)], True, True)]
            error = ""
            for rows, opens, closes in forms:
                try:
                    found = rows()
                except expat.ExpatError as e:
                    error = str(e)
                    continue
                name, declared = _prologue(piece) if opens else (root, "")
                # The document type follows the root's name, for the file's other pieces.
                return found, opens, closes, None, f"{name} {declared}".rstrip()
            # Where rows need what the file declares, its first piece still says what that is.
            return [], False, False, error, None
        except UnicodeDecodeError:
            return [], False, False, "not UTF-8", None

    def parse(batch: pa.RecordBatch) -> Iterable[Parsed]:
        where, pieces = places(batch), [p.removeprefix(b"\xef\xbb\xbf") for p in batch.column(0).to_pylist()]
        at = 0
        while at < len(pieces):
            stop, size, file = at, 0, where[at][0]
            while stop < len(pieces) and size < _CHUNK and where[stop][0] == file:
                size += len(pieces[stop])
                stop += 1
            doctype = doctypes.get(file, "")
            try:
                head = f"{doctype}<{_WITHIN}>".encode()
                found = [(rows, False, False, None, None) for rows in parse_together(pieces[at:stop], head)]
            except expat.ExpatError:
                found = [one for p in pieces[at:stop] for one in [_within(p, head, end) or parse_alone(p, doctype)]]
            yield from ((place, *x) for place, x in zip(where[at:stop], found, strict=True))
            at = stop

    return parse


def _within(piece: bytes, head: bytes, end: bytes) -> tuple | None:
    """A piece that holds nothing but rows, parsed alone."""
    try:
        return [row for _, row in _rows_of(head + piece + end + f"</{_WITHIN}>".encode())], False, False, None, None
    except expat.ExpatError:
        return None


def _document(path: str, content: bytes) -> Iterator[dict[str, str]]:
    found = _Rows()
    try:
        for at in range(0, len(content), _CHUNK):
            found.parser.Parse(content[at : at + _CHUNK])
            yield from (row for _, row in found.taken())
        found.parser.Parse(b"", True)
    except (expat.ExpatError, LookupError, ValueError) as e:
        raise ValueError(f"{path}: malformed XML: {e}") from None


def _parse_documents(batch: pa.RecordBatch) -> Iterable[Parsed]:
    for place, content in zip(places(batch), batch.column(0).to_pylist(), strict=True):
        yield place, _document(place[0], content), True, True, None, None


def _first_row(pieces: Iterator[bytes]) -> tuple[bool, str | None]:
    """Tag of the first row that is not self-closing, from pieces cut at `>`."""
    parser, open_, found = expat.ParserCreate("utf-8"), [], []

    def start(name: str, attributes: dict) -> None:
        open_.append(parser.CurrentByteIndex)

    def end(name: str) -> None:
        at = open_.pop()
        # A self-closing tag starts and ends at one place.
        if len(open_) == 1 and at != parser.CurrentByteIndex:
            found.append(name)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    for piece in pieces:
        try:
            parser.Parse(piece.removeprefix(b"\xef\xbb\xbf") + b">")
        except expat.ExpatError:
            return True, None
        if found:
            return True, found[0]
    return False, None


def _other_encoding(content: bytes) -> bool:
    """Whether a document's start declares, or shows, another encoding than UTF-8."""
    declared = _ENCODING.match(content)
    name = declared.group(1).lower() if declared else b"utf-8"
    return content[:2] in (b"\xfe\xff", b"\xff\xfe") or b"\x00" in content[:4] or name not in (b"utf-8", b"us-ascii", b"ascii")


def _row_tag(spark: SparkSession, path) -> str | None:
    """Tag of the first row of the largest file, found by one task that reads on from its start until that row closes."""
    _, largest = first_and_largest_file(spark, path)
    return reading_on(spark.read.option("lineSep", ">").text(largest).select(F.col("value").cast("binary")), _first_row)


def _pieces(spark: SparkSession, path, tag: str) -> DataFrame:
    # As bytes: they need not be UTF-8.
    pieces = spark.read.option("lineSep", f"</{tag}>").text(path)
    return pieces.select(F.col("value").cast("binary").alias("value"), file_order().alias(ORD))


def _documents(spark: SparkSession, path) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    zero = F.lit(0).cast("bigint")
    return files.select("content", F.struct(F.col("_metadata.file_path").alias("f"), zero.alias("b"), zero.alias("m")).alias(ORD))


def read_xml(spark: SparkSession, path, extra: list[str] | None = None) -> Raw:
    """Text columns of XML documents.

    Columns are the first row's element names without namespace, `extra` adds names that later rows may carry.
    Attributes are ignored, blanks kept; a missing element is NULL, an empty one `''`, of repeated ones the last
    counts; a value is all text below its element. Files whose rows close with one tag, that of the largest file's first
    row, are split there; others are parsed whole, each by itself. Malformed documents abort.
    """
    tag = _row_tag(spark, path)

    def split(files: list[str] | None, _):
        return Stage(_pieces(spark, path, tag), _pieces_parser(tag, {}), "xml") if tag else None

    def declared(files: list[str] | None, roots: dict[str, str]):
        """Files whose first piece has a document type, with that in front of all their pieces."""
        doctypes = {f: root.partition(" ")[2] for f, root in roots.items() if " " in root}
        return Stage(_pieces(spark, files, tag), _pieces_parser(tag, doctypes), "xml") if doctypes else None

    def whole(files: list[str] | None, _):
        return Stage(_documents(spark, files or path), _parse_documents, "xml")

    return read_staged(spark, [split, declared, whole]).raw(extra)
