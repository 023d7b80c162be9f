"""One XLSX workbook to text rows and back, for use inside tasks."""

from __future__ import annotations

import datetime as dt
import functools
import io
import itertools
import math
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

MAX_DATA_ROWS = 1_048_575
# Fixed value: name of the exported sheet.
SHEET_NAME = "Exported Data"

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_EPOCH = dt.datetime(1899, 12, 30)
# Built-in number formats that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def number_text(value: float) -> str:
    """Shortest round-trip text, scientific from 1E+15 up and below 1E-4."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    size = abs(value)
    digits, _, power = f"{value!r}".partition("e")
    if size and not 1e-4 <= size < 1e15:
        if not power:
            digits, _, power = f"{value:.16e}".partition("e") if float(f"{value:.15e}") != value else f"{value:.15e}".partition("e")
        digits = digits.rstrip("0").rstrip(".") if "." in digits else digits
        return f"{digits}E{'-' if int(power) < 0 else '+'}{abs(int(power)):02d}"
    return digits.removesuffix(".0")


def date_text(serial: float) -> str:
    moment = _EPOCH + dt.timedelta(seconds=round(serial * 86400))
    return moment.strftime("%m/%d/%Y %H:%M:%S")


def _unescape(text: str) -> str:
    if "_x" not in text:
        return text
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m.group(1), 16)), text)


def _rich_text(element) -> str:
    """Text of a string item, phonetic hints left out."""
    parts = [t.text or "" for t in element.findall(f"{_MAIN}t")]
    parts += [t.text or "" for t in element.findall(f"{_MAIN}r/{_MAIN}t")]
    return _unescape("".join(parts))


@functools.cache
def _column_of_letters(letters: str) -> int:
    n = 0
    for letter in letters:
        n = n * 26 + ord(letter) - 64
    return n


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = set()
    for f in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
        if re.search("[dmyhs]", code, re.I) and code.lower() != "general":
            custom.add(int(f.get("numFmtId")))
    formats = root.find(f"{_MAIN}cellXfs")
    return {
        i
        for i, xf in enumerate(formats if formats is not None else [])
        if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom
    }


def _first_sheet(book: zipfile.ZipFile) -> str | None:
    sheet = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    if sheet is None:
        return None
    for rel in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == sheet.get(f"{_REL}id"):
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return None


class _Sheet:
    """Rows of a sheet as they close, from an XML parser fed piece by piece: (row number, texts by column)."""

    def __init__(self, shared: list[str], dates: set[int]):
        self.shared, self.dates = shared, dates
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler = self._start
        self.parser.EndElementHandler = self._end
        self.parser.CharacterDataHandler = self._text
        self.rows: list[tuple[int, list[str]]] = []
        self.number, self.column, self.cells = 0, 0, []
        self.kind, self.style, self.value = "n", "0", []
        self.taking, self.hint = False, False

    def _start(self, name: str, attributes: dict) -> None:
        name = name.rpartition(":")[2]
        if name == "c":
            place = attributes.get("r")
            self.column = _column_of_letters(place.rstrip("0123456789")) if place else self.column + 1
            self.kind, self.style, self.value = attributes.get("t", "n"), attributes.get("s", "0"), []
        elif name == "v" or (name == "t" and not self.hint):
            self.taking = True
        elif name == "row":
            self.number = int(attributes.get("r", self.number + 1))
            self.column, self.cells = 0, []
        elif name == "rPh":
            self.hint = True

    def _end(self, name: str) -> None:
        name = name.rpartition(":")[2]
        if name == "c":
            text = self._cell("".join(self.value)) if self.value else ""
            if text:
                self.cells.extend([""] * (self.column - len(self.cells)))
                self.cells[self.column - 1] = text
        elif name in ("v", "t"):
            self.taking = False
        elif name == "row":
            if self.cells:
                self.rows.append((self.number, self.cells))
        elif name == "rPh":
            self.hint = False

    def _text(self, text: str) -> None:
        if self.taking:
            self.value.append(text)

    def _cell(self, value: str) -> str:
        kind = self.kind
        if kind == "n":
            number = float(value)
            return date_text(number) if self.dates and int(self.style) in self.dates else number_text(number)
        if kind in ("inlineStr", "str", "e"):
            return _unescape(value)
        if kind == "s":
            return self.shared[int(value)]
        if kind == "b":
            return "TRUE" if value.strip() == "1" else "FALSE"
        if kind == "d":
            return dt.datetime.fromisoformat(value).strftime("%m/%d/%Y %H:%M:%S")
        return value


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(row number, texts up to the last filled cell) of each filled row of the first sheet, as it is unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        name = _first_sheet(book)
        if name is None:
            return
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_rich_text(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        sheet = _Sheet(shared, _date_styles(book))
        with book.open(name) as stream:
            while piece := stream.read(1 << 18):
                sheet.parser.Parse(piece)
                rows, sheet.rows = sheet.rows, []
                yield from rows
        sheet.parser.Parse(b"", True)
        yield from sheet.rows


def header_and_rows(content: bytes) -> Iterator[list[str]]:
    """The header row, empty where there is none, then the data rows; rows of blanks only are dropped."""
    rows = sheet_rows(content)
    first = next(rows, None)
    if first is not None and first[0] == 1:
        yield first[1]
    else:
        yield []
        rows = itertools.chain([first] if first else [], rows)
    for _, cells in rows:
        if any(v.strip() for v in cells):
            yield cells


# The parts of a workbook with one sheet and one date style.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '<Override PartName="/xl/styles.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="xl/workbook.xml" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    f'<sheet name="{SHEET_NAME}" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/>'
    '<Relationship Id="rId2" Target="styles.xml" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts>'
    "<fonts><font/></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs>"
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.datetime):
        serial = (value.replace(tzinfo=None) - _EPOCH) / dt.timedelta(days=1)
        return f'<c s="1"><v>{serial!r}</v></c>'
    if isinstance(value, int) or (isinstance(value, float) and math.isfinite(value)):
        return f"<c><v>{value!r}</v></c>"
    text = number_text(value) if isinstance(value, float) else str(value)
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\r\ufffe\uffff]", lambda m: f"_x{ord(m.group(0)):04X}_", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(header: list[str], rows: Iterable[tuple]) -> tuple[bytes, int]:
    """A workbook with a header row and typed cells, and the number of its data rows.

    Datetimes, floats, ints and bools stay native, all else is text.
    """
    out = io.BytesIO()
    n_rows = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
            for row in ([header] if header else []):
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            for row in rows:
                n_rows += 1
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue(), n_rows
