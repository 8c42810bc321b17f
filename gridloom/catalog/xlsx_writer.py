"""Writes small workbooks, to have some to read."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

_BOOK = """<workbook xmlns:r="r"><sheets>{}</sheets></workbook>"""
_LINKS = "<Relationships>{}</Relationships>"


def workbook_bytes(sheets: dict[str, list[list]], extra: dict[str, str] | None = None) -> bytes:
    """A minimal workbook: text as shared strings, other values as they are."""
    strings: dict[str, int] = {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for number, rows in enumerate(sheets.values(), 1):
            lines = []
            for r, row in enumerate(rows, 1):
                line = []
                for c, value in enumerate(row):
                    at = f"{chr(65 + c)}{r}"
                    if isinstance(value, str):
                        line.append(f'<c r="{at}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>')
                    elif isinstance(value, bool):
                        line.append(f'<c r="{at}" t="b"><v>{int(value)}</v></c>')
                    elif value is not None:
                        line.append(f'<c r="{at}"><v>{value!r}</v></c>')
                lines.append(f'<row r="{r}">{"".join(line)}</row>')
            archive.writestr(
                f"xl/worksheets/sheet{number}.xml",
                f"<worksheet><sheetData>{''.join(lines)}</sheetData></worksheet>",
            )
        names = "".join(
            f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1)
        )
        links = "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)
        )
        items = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
        archive.writestr("xl/workbook.xml", _BOOK.format(names))
        archive.writestr("xl/_rels/workbook.xml.rels", _LINKS.format(links))
        archive.writestr("xl/sharedStrings.xml", f"<sst>{items}</sst>")
        for part, text in (extra or {}).items():
            archive.writestr(part, text)
    return out.getvalue()


def damaged(content: bytes, kind: int, most: int) -> bytes:
    """The book as it is (0, 1), with its first sheet cut in the middle (2), cut itself (3), or with a part
    that makes it larger than ``most`` (4)."""
    if kind < 2:
        return content
    if kind == 3:
        return content[: len(content) // 2]
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            part = old.read(name)
            new.writestr(name, part[: len(part) // 2] if kind == 2 and name.endswith("sheet1.xml") else part)
        if kind == 4:
            new.writestr("xl/media/image1.bin", bytes(most))
    return out.getvalue()
