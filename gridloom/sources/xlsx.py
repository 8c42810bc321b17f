"""The parts of an ``.xlsx`` file that hold cells. Runs inside tasks, on one file or sheet at a time.

Sheets are streamed: what is held is one row, the merged ranges open at it, and the shared texts.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from heapq import heappop, heappush
from typing import BinaryIO
from xml.etree import ElementTree

TEXT, NUMBER, BOOLEAN, DATETIME = "text", "number", "boolean", "datetime"
# The reasons a workbook is refused.
UNREADABLE = "No pudimos leer este archivo."
TOO_LARGE = "Este archivo contiene demasiada informacion para procesarlo."
# Number formats of the file format that mean a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


@dataclass(frozen=True)
class Limits:
    """Read caps, none by default. A sheet that a cap cuts is flagged, also if none of it is kept."""

    sheets: int | None = None
    rows: int | None = None
    columns: int | None = None
    unzipped_bytes: int | None = None


#: The caps of an interactive upload.
INTERACTIVE = Limits(50, 200_000, 256, 300 * 1024 * 1024)


#: Bytes of a sheet that are looked at together for its merged ranges, and the longest such entry.
CHUNK, ENTRY = 1 << 16, 1 << 10
SHEET_END = re.compile(rb"</(?:\w+:)?sheetData>")
MERGED = re.compile(rb'<(?:\w+:)?mergeCell [^>]*ref="([A-Z0-9:]+)"')


def refused(file: str, reason: str) -> dict:
    """The row that stands for a file that is not read."""
    return {"file": file, "sheet_index": -1, "row_index": -1, "error": reason}


def open_book(source: BinaryIO, limits: Limits) -> Workbook | None:
    """The directory of a workbook, or None if it is too large."""
    archive = zipfile.ZipFile(source)
    size = sum(entry.file_size for entry in archive.infolist())
    if limits.unzipped_bytes is not None and size > limits.unzipped_bytes:
        return None
    return Workbook(archive)


def sheet_rows(file: str, book: Workbook, index: int, limits: Limits) -> Iterator[dict]:
    """The rows of one sheet and its marker row."""
    name, part = book.sheets[index]
    base = {"file": file, "sheet_index": index, "sheet_name": name or f"Hoja {index + 1}"}
    cut = limits.sheets is not None and index >= limits.sheets
    for number, row in () if cut else book.rows(part, limits.columns):
        if limits.rows is not None and number > limits.rows:
            cut = True
            break
        if limits.columns is not None and len(row) > limits.columns:
            cut = cut or any(cell is not None for cell in row[limits.columns :])
            row = row[: limits.columns]
        yield base | {"row_index": number - 1, "cells": row}
    yield base | {"row_index": -1, "cells": [], "truncated": cut}


def workbook_rows(file: str, content: bytes, limits: Limits) -> Iterator[dict]:
    """The rows of all sheets. A damage that is met late comes after rows that were good."""
    try:
        book = open_book(io.BytesIO(content), limits)
        if book is None:
            yield refused(file, TOO_LARGE)
            return
        for index in range(len(book.sheets)):
            yield from sheet_rows(file, book, index, limits)
    except Exception:  # whatever a damaged file raises, it costs that file and not the job
        yield refused(file, UNREADABLE)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text_of(item: ElementTree.Element) -> str:
    """Plain or rich text; phonetic hints are not text."""
    if _local(item.tag) == "rPh":
        return ""
    if _local(item.tag) == "t":
        return item.text or ""
    return "".join(_text_of(child) for child in item)


def _row(reference: str) -> int:
    return int(reference.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _column(reference: str) -> int:
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _is_date_format(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code)
    return re.search(r"[dmyhs]", bare, re.IGNORECASE) is not None


class Workbook:
    """The parts of one workbook that its cells refer to."""

    def __init__(self, archive: zipfile.ZipFile) -> None:
        self._archive = archive
        self._names = set(archive.namelist())
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        targets = {
            link.get("Id"): link.get("Target", "")
            for link in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        }
        self.sheets: list[tuple[str, str]] = []
        old_epoch = False
        for element in book.iter():
            if _local(element.tag) == "workbookPr":
                old_epoch = element.get("date1904") in ("1", "true")
            if _local(element.tag) == "sheet":
                link = next(v for k, v in element.attrib.items() if _local(k) == "id")
                target = targets[link].lstrip("/")
                part = target if target.startswith("xl/") else f"xl/{target}"
                if "worksheets/" in part:
                    self.sheets.append((element.get("name", ""), part))
        self._epoch = datetime(1904, 1, 1) if old_epoch else datetime(1899, 12, 30)
        self._texts: list[str] | None = None
        self._styles: list[bool] | None = None

    def _children(self, part: str) -> list[ElementTree.Element]:
        if part not in self._names:
            return []
        return list(ElementTree.fromstring(self._archive.read(part)))

    @property
    def _strings(self) -> list[str]:
        """Shared texts, read with the first sheet that is."""
        if self._texts is None:
            self._texts = [_text_of(item) for item in self._children("xl/sharedStrings.xml")]
        return self._texts

    @property
    def _dates(self) -> list[bool]:
        if self._styles is None:
            self._styles = self._date_styles()
        return self._styles

    def _date_styles(self) -> list[bool]:
        custom, styles = {}, []
        for group in self._children("xl/styles.xml"):
            if _local(group.tag) == "numFmts":
                custom = {f.get("numFmtId"): f.get("formatCode", "") for f in group}
            if _local(group.tag) == "cellXfs":
                styles = [style.get("numFmtId", "0") for style in group]
        return [
            _is_date_format(custom[s]) if s in custom else int(s) in DATE_FORMATS for s in styles
        ]

    def _references(self, part: str) -> list[bytes]:
        """The merged ranges of a sheet, which follow its rows."""
        found, held, below = [], b"", False
        with self._archive.open(part) as stream:
            while chunk := stream.read(CHUNK):
                held += chunk
                if not below:
                    end = SHEET_END.search(held)
                    below, held = end is not None, held[end.end() :] if end else held[-ENTRY:]
                if below:
                    matches = list(MERGED.finditer(held))
                    found += [m[1] for m in matches]
                    # What may be the start of an entry is looked at again.
                    held = held[max(matches[-1].end() if matches else 0, len(held) - ENTRY) :]
        return found

    def rows(self, part: str, columns: int | None = None) -> Iterator[tuple[int, list[dict | None]]]:
        """Row number and cells of each row, with merged ranges filled from their first cell.

        With ``columns``, ranges are filled to one column beyond that, which shows that there is more.
        """
        merges, number, parent = _Merges(self._references(part), columns), 0, None
        with self._archive.open(part) as stream:
            for event, element in ElementTree.iterparse(stream, ("start", "end")):
                name = _local(element.tag)
                if event == "start":
                    parent = element if name == "sheetData" else parent
                    continue
                if name != "row":
                    continue
                at = int(element.get("r", number + 1))
                yield from merges.between(number, at)
                row: list[dict | None] = []
                for position, cell in enumerate(element):
                    place = _column(cell.get("r")) if cell.get("r") else position
                    row.extend([None] * (place + 1 - len(row)))
                    row[place] = self._readable(cell)
                yield at, merges.filled(at, row)
                number = at
                # Rows that were read would stay as children of the sheet.
                element.clear() if parent is None else parent.clear()
        yield from merges.between(number, None)

    def _readable(self, cell: ElementTree.Element) -> dict | None:
        """The value of a cell; one that can't be read is blank and costs no other cell."""
        try:
            return self._value(cell)
        except (ValueError, OverflowError, IndexError):
            return None

    def _value(self, cell: ElementTree.Element) -> dict | None:
        kind = cell.get("t", "n")
        inline = value = None
        for child in cell:
            if _local(child.tag) == "v":
                value = child.text
            elif _local(child.tag) == "is":
                inline = _text_of(child)
        if kind == "inlineStr":
            return {"kind": TEXT, "s": inline or ""}
        if value is None or kind == "e":
            return None
        if kind == "s":
            return {"kind": TEXT, "s": self._strings[int(value)]}
        if kind == "str":
            return {"kind": TEXT, "s": value}
        if kind == "b":
            return {"kind": BOOLEAN, "b": value == "1"}
        if kind == "d":
            return {"kind": DATETIME, "t": datetime.fromisoformat(value).replace(tzinfo=None)}
        number = float(value)
        style = int(cell.get("s", "0"))
        if style < len(self._dates) and self._dates[style]:
            return {"kind": DATETIME, "t": self._epoch + timedelta(milliseconds=round(number * 86_400_000))}
        return {"kind": NUMBER, "n": number}


class _Merges:
    """A sweep down the rows over merged ranges; only those open at the row are held with a value."""

    def __init__(self, references: list[bytes], columns: int | None) -> None:
        ranges = []
        for reference in references:
            first, _, last = reference.decode().partition(":")
            last = last or first
            ranges.append((_row(first), _column(first), _row(last), _column(last)))
        self._coming = sorted(ranges, reverse=True)
        self._open: list[tuple] = []
        self._columns, self._count = columns, 0

    def filled(self, number: int, row: list[dict | None]) -> list[dict | None]:
        """The cells of a row with those of the ranges that cover it."""
        while self._open and self._open[0][0] < number:
            heappop(self._open)
        while self._coming and self._coming[-1][0] <= number:
            top, left, bottom, right = self._coming.pop()
            value = row[left] if top == number and left < len(row) else None
            if bottom >= number:
                self._count += 1
                heappush(self._open, (bottom, self._count, top, left, right, value))
        for _, _, top, left, right, value in self._open:
            right = right if self._columns is None else min(right, self._columns)
            left += top == number
            if left <= right:
                row.extend([None] * (right + 1 - len(row)))
                row[left : right + 1] = [value] * (right + 1 - left)
        return row

    def between(self, number: int, stop: int | None) -> Iterator[tuple[int, list[dict | None]]]:
        """Rows after ``number`` and before ``stop`` that exist only as part of a merged range."""
        number += 1
        while stop is None or number < stop:
            while self._open and self._open[0][0] < number:
                heappop(self._open)
            if not self._open:
                if not self._coming:
                    return
                number = max(number, self._coming[-1][0])
                if stop is not None and number >= stop:
                    return
            row = self.filled(number, [])
            if row or any(top < number for _, _, top, *_ in self._open):
                yield number, row
            number += 1
