"""DOCX and XLSX files read from their zip and XML, as texts and tables."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from posixpath import join, normpath
from xml.etree import ElementTree

# The namespaces of the formats, and the numbers of the built-in formats that show a date or a time.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
# Fixed value: the heading of a sheet.
SHEET = "【工作表: {}】\n"
#: Bytes that one part may have when it is unpacked; a file that claims more is an error and not a full memory.
MOST = 256 * 1024 * 1024

Table = list[list[str]]


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MOST:
        raise ValueError(f"{name} is too large when unpacked")
    return ElementTree.fromstring(archive.read(name))


def _paragraph(p: ElementTree.Element) -> str:
    """The text of a paragraph's runs, with tabs and line breaks; deleted text isn't in a run's text."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter())


def docx(raw: bytes) -> list[tuple[str, str | Table]]:
    """The paragraphs of the body that aren't blank, then its tables, each cell with its paragraphs on lines of their own."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = _part(archive, "word/document.xml").find(f"{_W}body")
    texts = [("", t) for p in body.findall(f"{_W}p") if (t := _paragraph(p).strip())]
    cells = lambda row: ["\n".join(map(_paragraph, c.findall(f"{_W}p"))) for c in row.findall(f"{_W}tc")]
    return texts + [("", [cells(row) for row in table.findall(f"{_W}tr")]) for table in body.findall(f"{_W}tbl")]


def _column(reference: str) -> int:
    """The place, from 0, that the letters of a cell's reference name."""
    place = 0
    for letter in re.match(r"[A-Za-z]*", reference)[0].upper():
        place = 26 * place + ord(letter) - 64
    return place - 1


def _number(text: str, is_date: bool, epoch: datetime) -> str:
    value = float(text)
    if is_date:
        moment = epoch + timedelta(microseconds=round(value * 86_400_000_000))
        return str(moment) if value >= 1 else str(moment.time())
    return text if not re.fullmatch(r"-?\d+\.0+", text) else text.split(".")[0]


def xlsx(raw: bytes) -> list[tuple[str, str | Table]]:
    """Every worksheet in the order of the book: its heading, and its rows from the first to the last that is there; stored values stand for formulas."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = set(archive.namelist())
        book = _part(archive, "xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in _part(archive, "xl/_rels/workbook.xml.rels")}
        shared = [_shared(s) for s in _part(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(_part(archive, "xl/styles.xml")) if "xl/styles.xml" in names else []
        properties = book.find(f"{_S}workbookPr")
        epoch = datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        out = []
        for sheet in book.find(f"{_S}sheets"):
            target = targets[sheet.get(_R)]
            path = target.lstrip("/") if target.startswith("/") else normpath(join("xl", target))
            root = _part(archive, path)
            if root.tag == f"{_S}worksheet":  # a chart's sheet has no cells
                out.append((SHEET.format(sheet.get("name")), _rows(root, shared, dates, epoch)))
        return out


def _shared(item: ElementTree.Element) -> str:
    """A shared string: its text, or that of its runs; how it is pronounced is no part of it."""
    own = item.findall(f"{_S}t") + [t for run in item.findall(f"{_S}r") for t in run.findall(f"{_S}t")]
    return "".join(t.text or "" for t in own)


def _date_styles(styles: ElementTree.Element) -> list[bool]:
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in styles.iter(f"{_S}numFmt")}
    formats = styles.find(f"{_S}cellXfs")
    ids = [int(x.get("numFmtId") or 0) for x in formats] if formats is not None else []
    return [i in _DATES or bool(re.search("[dmyhsDMYHS]", own.get(i, ""))) for i in ids]


def _rows(sheet: ElementTree.Element, shared: list[str], dates: list[bool], epoch: datetime) -> Table:
    rows: Table = []
    for row in sheet.iter(f"{_S}row"):
        cells: list[str] = []
        for cell in row.findall(f"{_S}c"):
            at = _column(cell.get("r")) if cell.get("r") else len(cells)
            cells += [""] * (at - len(cells))
            cells.append(_value(cell, shared, dates, epoch))
        rows += [[]] * (int(row.get("r") or 0) - 1 - len(rows))
        rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _value(cell: ElementTree.Element, shared: list[str], dates: list[bool], epoch: datetime) -> str:
    kind, value = cell.get("t") or "n", cell.findtext(f"{_S}v")
    if kind == "inlineStr":
        inline = cell.find(f"{_S}is")
        return "" if inline is None else _shared(inline)
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    style = int(cell.get("s") or 0)
    return _number(value, style < len(dates) and dates[style], epoch) if kind == "n" else value
