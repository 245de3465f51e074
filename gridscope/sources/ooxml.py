"""Workbooks in Office Open XML, read with the standard library alone."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

#: Rows and columns read, size above which only fills and number formats count, and caps of the package scan.
ROWS_MOST, COLS_MOST, PLAIN_ABOVE = 10_000, 500, 5 << 20
REFS_MOST, SHEET_BYTES, DRAWING_BYTES = 50_000, 100 << 20, 50 << 20
#: Built-in number formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"


def cell_ref(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", text)
    if not m:
        raise ValueError(f"not a cell: {text}")
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def range_ref(text: str) -> tuple[int, int, int, int]:
    a, _, b = text.partition(":")
    r0, c0 = cell_ref(a)
    r1, c1 = cell_ref(b or a)
    return min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1)


@dataclass
class Style:
    bold: bool = False
    italic: bool = False
    font: str | None = None
    bg: str | None = None
    number_format: str = "General"
    alignment: str | None = None
    border: tuple = (None, None, None, None)
    is_date: bool = False


@dataclass
class SheetData:
    name: str
    hidden: bool = False
    cells: dict = field(default_factory=dict)  # (row, col) -> (vtype, text, number, formula, Style)
    merges: list = field(default_factory=list)
    hidden_rows: list = field(default_factory=list)
    hidden_cols: list = field(default_factory=list)
    row_levels: dict = field(default_factory=dict)
    col_levels: dict = field(default_factory=dict)
    formulas: list = field(default_factory=list)
    errors: list = field(default_factory=list)
    objects: list = field(default_factory=list)
    formula_error: str | None = None
    object_error: str | None = None


class Package:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, part: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(part)) if part in self.names else None

    def rels(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id -> type and part."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            out[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
        return out

    def sheets(self) -> list[tuple[str, str, bool]]:
        book = next((p for k, p in self.rels("").values() if k == "officeDocument"), "xl/workbook.xml")
        rels, root = self.rels(book), self.xml(book)
        return [(s.get("name"), rels[s.get(f"{_REL}id")][1], s.get("state", "visible") != "visible") for s in root.iter(f"{_MAIN}sheet") if rels.get(s.get(f"{_REL}id"), ("",))[0] == "worksheet"]


def _rgb(node: ET.Element | None) -> str | None:
    return node.get("rgb") if node is not None else None


def _styles(package: Package) -> list[Style]:
    root = package.xml("xl/styles.xml")
    if root is None:
        return [Style()]
    find = lambda path: root.findall("/".join(_MAIN + p for p in path.split("/")))
    formats = {int(n.get("numFmtId")): n.get("formatCode", "") for n in find("numFmts/numFmt")}
    fonts, fills, borders = find("fonts/font"), find("fills/fill"), find("borders/border")

    def on(font: ET.Element, tag: str) -> bool:
        node = font.find(_MAIN + tag)
        return node is not None and node.get("val", "1") not in ("0", "false")

    out = []
    for xf in find("cellXfs/xf"):
        style, number = Style(), int(xf.get("numFmtId", 0))
        style.number_format = formats.get(number, "General" if number == 0 else str(number))
        style.is_date = number in DATE_FORMATS or number in formats and bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats[number].lower())))
        if (k := int(xf.get("fontId", 0))) < len(fonts):
            style.bold, style.italic, style.font = on(fonts[k], "b"), on(fonts[k], "i"), _rgb(fonts[k].find(_MAIN + "color"))
            if style.font == "00000000":
                style.font = None
        if (k := int(xf.get("fillId", 0))) < len(fills):
            pattern = fills[k].find(_MAIN + "patternFill")
            if pattern is not None and pattern.get("patternType", "none") != "none":
                style.bg = _rgb(pattern.find(_MAIN + "fgColor"))
        if (k := int(xf.get("borderId", 0))) < len(borders):
            side = lambda name, b=borders[k]: (b.find(_MAIN + name).get("style") if b.find(_MAIN + name) is not None else None)
            style.border = tuple(side(x) for x in ("left", "right", "top", "bottom"))
        if (align := xf.find(_MAIN + "alignment")) is not None:
            style.alignment = align.get("horizontal")
        out.append(style)
    return out or [Style()]


def _strings(package: Package) -> list[str]:
    root = package.xml("xl/sharedStrings.xml")
    return [] if root is None else ["".join(t.text or "" for p in si.iter() if p.tag in (f"{_MAIN}t",) for t in (p,)) for si in root.findall(f"{_MAIN}si")]


def _value(c: ET.Element, strings: list[str], style: Style, epoch: dt.datetime) -> tuple:
    """(type, text as Python writes it, number)."""
    kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        return ("str", text, None) if text else (None, None, None)
    if v is None:
        return None, None, None
    if kind == "s":
        return "str", strings[int(v)], None
    if kind == "b":
        return "bool", str(v == "1"), float(v == "1")
    if kind in ("str", "e"):
        return "str", v, None
    if kind == "d":
        return "date", v.replace("T", " "), None
    x = float(v)
    if style.is_date:
        when = epoch + dt.timedelta(days=x)
        when = (when + dt.timedelta(microseconds=500)).replace(microsecond=0)
        return "date", str(when.time() if 0 <= x < 1 else when), x
    return "num", str(int(v) if re.fullmatch(r"-?\d+", v) else x), x


def _used(cells: dict) -> int:
    """A used width that stray formats at the right edge don't widen."""
    width = max((c for _, c in cells), default=0)
    if width < 256:
        return width
    top = max((c for (r, c), x in cells.items() if r <= 100 and x[0] is not None), default=width)
    return min(width, top + 5)


def read(content: bytes) -> list[SheetData]:
    package = Package(content)
    styles, strings, plain = _styles(package), _strings(package), len(content) > PLAIN_ABOVE
    book = package.xml("xl/workbook.xml")
    props = book.find(f"{_MAIN}workbookPr") if book is not None else None
    epoch = dt.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    out = []
    for name, part, hidden in package.sheets():
        sheet = SheetData(name, hidden)
        out.append(sheet)
        size = package.zip.getinfo(part).file_size
        with package.zip.open(part) as f:
            _sheet(f, sheet, styles, strings, plain, epoch, size)
        if not plain:
            width = _used(sheet.cells)
            sheet.cells = {k: v for k, v in sheet.cells.items() if k[1] <= width}
        _objects(package, part, sheet)
    return out


def _sheet(f, sheet: SheetData, styles, strings, plain: bool, epoch, size: int) -> None:
    if size > SHEET_BYTES:
        sheet.formula_error = "worksheet too large"
    for _, node in ET.iterparse(f):
        tag = node.tag.removeprefix(_MAIN)
        if tag == "c":
            r, c = cell_ref(node.get("r"))
            style = styles[min(int(node.get("s", 0)), len(styles) - 1)]
            kind, text, number = _value(node, strings, style, epoch)
            formula = node.find(f"{_MAIN}f")
            if formula is not None and not sheet.formula_error:
                sheet.formulas.append((r, c, formula.text))
            if text == "#REF!" and (formula is not None or node.get("t") == "e") and not sheet.formula_error:
                sheet.errors.append((r, c, formula.text if formula is not None else None))
            if len(sheet.formulas) > REFS_MOST or len(sheet.errors) > REFS_MOST:
                sheet.formulas, sheet.errors, sheet.formula_error = [], [], "too many references"
            shown = None
            if kind == "str" and text.startswith("="):
                shown, kind, text = text, None, None
            elif formula is not None and formula.text:
                shown = "=" + formula.text
            if plain:
                style = Style(bg=style.bg, number_format=style.number_format)
            if r <= ROWS_MOST and c <= COLS_MOST and (kind is not None or shown or style.bold):
                sheet.cells[r, c] = (kind, text, number, shown, style)
            node.clear()
        elif tag == "row":
            r = int(node.get("r", 0))
            if node.get("hidden") in ("1", "true"):
                sheet.hidden_rows.append(r)
            if node.get("outlineLevel", "0") != "0":
                sheet.row_levels[r] = int(node.get("outlineLevel"))
            node.clear()
        elif tag == "col":
            a, b = int(node.get("min")), int(node.get("max"))
            if node.get("hidden") in ("1", "true"):
                sheet.hidden_cols += range(a, min(b, COLS_MOST) + 1)
            if node.get("outlineLevel", "0") != "0":
                sheet.col_levels |= dict.fromkeys(range(a, min(b, COLS_MOST) + 1), int(node.get("outlineLevel")))
        elif tag == "mergeCell":
            sheet.merges.append(range_ref(node.get("ref")))


def _objects(package: Package, part: str, sheet: SheetData) -> None:
    for kind, drawing in package.rels(part).values():
        if kind != "drawing" or drawing not in package.names:
            continue
        if package.zip.getinfo(drawing).file_size > DRAWING_BYTES:
            sheet.objects, sheet.object_error = [], "drawing too large"
            return
        for anchor in package.xml(drawing):
            start = anchor.find(f"{_DRAW}from")
            if start is None:
                continue
            found = next((name for tag, name in (("pic", "image"), ("graphicFrame", "chart"), ("sp", "shape"), ("cxnSp", "connector")) if anchor.find(_DRAW + tag) is not None), None)
            if found:
                sheet.objects.append((int(start.findtext(f"{_DRAW}row")) + 1, int(start.findtext(f"{_DRAW}col")) + 1, found))
        if len(sheet.objects) > REFS_MOST:
            sheet.objects, sheet.object_error = [], "too many objects"
            return
