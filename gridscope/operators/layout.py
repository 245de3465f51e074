"""Where the tables of a sheet are, and what their header, body and columns are.

The steps depend on each other's order (bands, trimming, merging of neighbours,
header inheritance), so a sheet is laid out by one task, which gets its cells as
Arrow rows. Counting operators that need no order are DataFrame functions; see
bands.py and columns.py.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.functions.text import DATE, MISSING, NUMBER
from gridscope.model import REGION

#: Fixed values of layout inference.
GAP, HEADER_ROWS, FORM_WIDTH, FORM_OVERLAP = 1, 5, 3, 0.8
STUBS, STUB_SCORE, STUB_RATE, NO_FILL = 3, 2, 0.8, {"FFFFFFFF"}
TOTAL = re.compile(r"^(合計|小計|総計|計|総数|総合計|3カ年平均)$")
NOTE = re.compile(r"^\s*(※|（注）|注[：:）)]|備考)")
SOURCE = ("出典", "Source", "source", "参考", "出所", "資料")
SUM = re.compile(r"^=\s*(SUM|SUBTOTAL)\b", re.IGNORECASE)
_NUMBER, _DATE, _MISSING = re.compile(NUMBER), re.compile(DATE), set(MISSING)


@dataclass
class Cell:
    kind: str | None  # str, num, bool, date, other; None without a value
    text: str | None = None
    formula: str | None = None
    master: tuple[int, int] | None = None
    bold: bool = False
    bg: str | None = None
    left: str | None = None
    right: str | None = None

    @property
    def numeric(self) -> bool:
        return self.kind in ("num", "bool")

    @property
    def stripped(self) -> str:
        return (self.text or "").strip()

    @property
    def number_text(self) -> bool:
        """A string that is a data number, not a mere column number."""
        s = self.stripped
        return self.kind == "str" and bool(_NUMBER.match(s)) and ("," in s or "." in s or len(s.lstrip("+-")) >= 3)


@dataclass
class Region:
    top: int
    left: int
    bottom: int
    right: int
    confidence: float = 0.0
    header_rows: list[int] = field(default_factory=list)
    body_start: int = 0
    body_end: int = 0
    headers: dict[int, str] = field(default_factory=dict)
    merged_headers: list[int] = field(default_factory=list)
    types: dict[int, str] = field(default_factory=dict)
    stubs: list[int] = field(default_factory=list)

    @property
    def width(self) -> int:
        return self.right - self.left + 1

    @property
    def height(self) -> int:
        return self.bottom - self.top + 1


class Grid:
    """Cells of a sheet by row."""

    def __init__(self, cells: dict[tuple[int, int], Cell], merges: list[tuple[int, int, int, int]]):
        self.rows: dict[int, dict[int, Cell]] = defaultdict(dict)
        for (r, c), x in sorted(cells.items()):
            self.rows[r][c] = x
        self.merges = merges

    def span(self, r: int, left: int, right: int) -> list[tuple[int, Cell]]:
        row = self.rows.get(r, {})
        return [(c, row[c]) for c in range(left, right + 1) if c in row] if right - left < len(row) * 4 else [(c, x) for c, x in row.items() if left <= c <= right]

    def filled(self, r: int, left: int, right: int) -> list[tuple[int, Cell]]:
        return [(c, x) for c, x in self.span(r, left, right) if x.kind]

    def get(self, r: int, c: int) -> Cell | None:
        return self.rows.get(r, {}).get(c)

    def within(self, left: int, right: int) -> list[tuple[int, int, int, int]]:
        return [m for m in self.merges if m[1] >= left and m[3] <= right]


def bands(indices: list[int], gap: int = GAP) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i in sorted(indices):
        if out and i - out[-1][1] <= gap:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [tuple(b) for b in out]


def strength(grid: Grid, r: int, left: int, right: int) -> int:
    """2: set apart by bold type or merges; 1: text alone; 0: neither."""
    filled = grid.filled(r, left, right)
    if not filled:
        return 0
    if any(x.bold for _, x in filled):
        return 2
    if any(x.master for _, x in filled):
        here = [m for m in grid.within(left, right) if m[0] <= r <= m[2]]
        if any(m[3] > m[1] for m in here) or sum(m[2] > m[0] for m in here) >= 3:
            return 2
    if any(x.kind != "str" for _, x in filled):
        return 0
    said = [x for _, x in filled if x.stripped and x.stripped not in _MISSING]
    return int(sum(x.number_text for x in said) <= 0.3 * max(len(said), 1))


def signature(grid: Grid, r: int, left: int, right: int) -> list[str]:
    row = grid.rows.get(r, {})
    kind = lambda x: "none" if x is None or not x.kind else "num" if x.numeric else x.kind if x.kind == "str" else "other"
    return [kind(row.get(c)) for c in range(left, right + 1)]


def _has_number(grid: Grid, r: int, left: int, right: int) -> bool:
    filled = grid.filled(r, left, right)
    return any(x.numeric for _, x in filled) or any(x.number_text for _, x in filled)


def heads_on(grid: Grid, top: int, bottom: int, left: int, right: int) -> bool:
    """Whether a band of rows looks like a header set off from its body by blank rows."""
    width, strong = right - left + 1, False
    for r in range(top, bottom + 1):
        s = strength(grid, r, left, right)
        strong |= s == 2
        if s:
            continue
        n = len(grid.filled(r, left, right))
        if n == 0 or n <= 2 and width >= 3:
            continue
        if n / width > 0.3 and _has_number(grid, r, left, right):
            return False
    return strong


def join_bands(grid: Grid, rows: list[tuple[int, int]], cols: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if len(rows) < 2 or not cols:
        return rows
    left, right = max(cols, key=lambda b: b[1] - b[0])
    out = [rows[0]]
    for top, bottom in rows[1:]:
        a, b = out[-1]
        size = b - a + 1
        tall = any(a <= m[0] <= b and m[2] > m[0] for m in grid.within(left, right))
        most = max(HEADER_ROWS + 5, size + 2 if tall else 0)
        if top - b - 1 <= 1 and size <= most and heads_on(grid, a, b, left, right):
            out[-1] = (a, bottom)
        else:
            out.append((top, bottom))
    return out


def _is_title(grid: Grid, r: int, left: int, right: int) -> bool:
    width, n = right - left + 1, len(grid.filled(r, left, right))
    signal = any(x.master or x.bold for _, x in grid.span(r, left, right))
    if n == 1 and signal:
        return width >= 4
    return not signal and (n / width <= 0.15 or 1 <= n <= 2)


def _tail_kind(grid: Grid, r: int, left: int, right: int) -> str | None:
    """What a row at the end is instead of data; None for data."""
    filled = [x for _, x in grid.filled(r, left, right)]
    if not filled:
        return "blank"
    if any(x.formula and SUM.match(x.formula) for x in filled):
        return "total"
    if any(TOTAL.match(x.stripped) for x in [x for x in filled if x.kind == "str"][:3]):
        return "total"
    first = filled[0]
    if first.kind != "str":
        return None
    if NOTE.match(first.text):
        return "note"
    share = len(filled) / (right - left + 1)
    if share < 0.3 and first.stripped.startswith(SOURCE):
        return "source"
    return "note" if share <= 0.2 else None


def trim(grid: Grid, top: int, bottom: int, left: int, right: int) -> tuple[int, int, list[tuple[int, int, str, str]]]:
    """The rows left as a table, and the cells cut off as (row, col, text, kind)."""
    others: list[tuple[int, int, str, str]] = []
    width = right - left + 1

    def cut(r: int, kind: str) -> None:
        others.extend((r, c, x.text, kind) for c, x in grid.filled(r, left, right))

    while width >= 3 and top < bottom and _is_title(grid, top, left, right):
        cut(top, "title")
        top += 1
    while bottom > top and (kind := _tail_kind(grid, bottom, left, right)):
        if kind != "blank":
            cut(bottom, kind)
        bottom -= 1
    if top == bottom and width >= 3:
        filled = grid.filled(top, left, right)
        if filled and len(filled) / width <= 0.2 and all(x.kind == "str" for _, x in filled):
            cut(top, "note")
            top += 1
    return top, bottom, others


def fill(grid: Grid, x: Region) -> tuple[float, float]:
    """Share of cells filled, and of rows with data."""
    least = max(min(x.width * 0.3, 2), 1)
    n = [len(grid.filled(r, x.left, x.right)) for r in range(x.top, x.bottom + 1)]
    return sum(n) / (x.width * x.height), sum(k >= least for k in n) / x.height


def header(grid: Grid, x: Region) -> tuple[list[int], int]:
    """Header rows, and where the body starts."""
    top, bottom, left, right = x.top, x.bottom, x.left, x.right
    if top == bottom:
        return [], top
    merges = [m for m in grid.within(left, right) if m[2] > m[0]]
    depth = max([HEADER_ROWS] + [m[2] - top + 1 for m in merges if top <= m[0] < top + HEADER_ROWS])
    depth = min(depth, max(x.height // 2, HEADER_ROWS))
    power = lambda r: strength(grid, r, left, right)
    found, r = [], top
    while r <= bottom and r < top + depth:
        if power(r):
            found.append(r)
        elif not grid.filled(r, left, right) and found and r + 1 <= bottom and power(r + 1):
            pass
        else:
            break
        r += 1
    if not found:
        if any(c.numeric for _, c in grid.filled(top, left, right)) and signature(grid, top, left, right) == signature(grid, top + 1, left, right):
            return [], top
        found, r = [top], top + 1
        while r < min(bottom, top + depth) and power(r):
            found.append(r)
            r += 1
    strong = [r for r in found if power(r) == 2]
    if strong and len(found) > 1:
        reach = max([m[2] for m in merges if m[0] in found], default=0)
        if reach:
            found = [r for r in found if r <= reach] or found[:1]
    elif not strong and len(found) > 1:
        after = found[-1] + 1
        if not (after <= bottom and _has_number(grid, after, left, right) and signature(grid, after, left, right) != signature(grid, found[0], left, right)):
            found = found[:1]
    if len(found) > 1:
        cover = {r: len({c for c, v in grid.span(r, left, right) if v.kind or v.master}) for r in found}
        most = max(cover.values())
        found = [r for r in found if cover[r] >= 0.2 * most or cover[r] >= 0.3 * x.width] or found[:1]
    for m in merges:
        if m[0] in found and found[-1] < m[2] <= min(top + 4, bottom - 1):
            found += range(found[-1] + 1, m[2] + 1)
    body = found[-1] + 1 if found[-1] < bottom else bottom
    if len(found) >= HEADER_ROWS and bottom - body + 1 <= 2:
        found, body = found[:1], found[0] + 1
    elif len(found) > HEADER_ROWS:
        found = found[:HEADER_ROWS]
        body = found[-1] + 1
    return found, body


def labels(grid: Grid, x: Region) -> None:
    for c in range(x.left, x.right + 1):
        said: list[str] = []
        for r in x.header_rows:
            cell = grid.get(r, c)
            if cell is None:
                continue
            if cell.master:
                if c not in x.merged_headers:
                    x.merged_headers.append(c)
                if not cell.kind:
                    cell = grid.get(*cell.master) or cell
            if cell.kind and cell.stripped and said[-1:] != [cell.stripped]:
                said.append(cell.stripped)
        x.headers[c] = " / ".join(said)


def vote(counts: dict[str, int]) -> str:
    """A kind that four fifths of the values have."""
    n = sum(v for k, v in counts.items() if k != "empty")
    return next((k for k in ("numeric", "date", "text") if n and counts.get(k, 0) >= 0.8 * n), "mixed") if n else "empty"


def kind_of(cell: Cell) -> str:
    if not cell.kind:
        return "empty"
    if cell.kind in ("num", "bool"):
        return "numeric"
    if cell.kind != "str":
        return "date" if cell.kind == "date" else "text"
    s = cell.stripped
    return "empty" if not s or s in _MISSING else "date" if _DATE.match(s) else "numeric" if _NUMBER.match(s) else "text"


def _serial(cells: list[Cell]) -> bool:
    """Distinct positive whole numbers, as codes and counters are."""
    seen = set()
    for x in cells:
        whole = x.stripped.removesuffix(".0") if x.numeric else x.stripped if x.kind == "str" else ""
        if not whole.isdecimal() or int(whole) <= 0 or int(whole) in seen:
            return False
        seen.add(int(whole))
    return len(seen) >= 2


def stub_columns(grid: Grid, x: Region) -> list[int]:
    rows = range(x.body_start, x.body_end + 1)

    def edge(c: int) -> float:
        """Share of rows with a line on the column's right side."""
        on = lambda r: (a := grid.get(r, c)) is not None and a.right or c < x.right and (b := grid.get(r, c + 1)) is not None and b.left
        return sum(bool(on(r)) for r in rows) / len(rows) if len(rows) else 0.0

    out = []
    for c in range(x.left, x.left + min(STUBS, x.width - 1)):
        filled = [v for r in rows if (v := grid.get(r, c)) is not None and v.kind]
        kind = x.types.get(c)
        score = {"text": 2, "mixed": 1, "numeric": 0 if len(rows) and _serial(filled) else -2, "date": -2}.get(kind, 0)
        if len(rows):
            score += 2 * (edge(c) - edge(c + 1) > STUB_RATE) if c < x.right else 0
        if filled:
            score += 2 * (sum(v.bg is not None and v.bg not in NO_FILL for v in filled) / len(filled) > STUB_RATE)
            score += sum(v.bold for v in filled) / len(filled) > STUB_RATE
        if score >= STUB_SCORE:
            out.append(c)
    return out


def describe(grid: Grid, x: Region) -> Region:
    x = replace(x, headers={}, merged_headers=[], types={})
    x.header_rows, x.body_start = header(grid, x)
    x.body_end = x.bottom
    if x.header_rows:
        labels(grid, x)
    type_columns(grid, x)
    x.stubs = stub_columns(grid, x)
    return x


def type_columns(grid: Grid, x: Region) -> None:
    counts: dict[int, dict[str, int]] = {c: defaultdict(int) for c in range(x.left, x.right + 1)}
    for r in range(x.body_start, x.body_end + 1):
        for c, cell in grid.span(r, x.left, x.right):
            counts[c][kind_of(cell)] += 1
    x.types = {c: vote(n) for c, n in counts.items()}


def sure(grid: Grid, x: Region, a: float = 0.6, b: float = 0.6) -> Region:
    cells, rows = fill(grid, x)
    return replace(x, confidence=round(min(cells * a + rows * b, 1.0), 3))


def beside(grid: Grid, tables: list[Region]) -> list[Region]:
    """Join tables that one blank column parts, where rows and headers agree."""
    left = sorted(tables, key=lambda t: (t.top, t.left))
    out = []
    while left:
        now, rest = left[0], []
        for t in left[1:]:
            a, b = set(now.header_rows), set(t.header_rows)
            if abs(now.top - t.top) <= 1 and abs(now.bottom - t.bottom) <= 1 and t.left - now.right - 1 == GAP and (a <= b or b <= a):
                now = sure(grid, describe(grid, Region(min(now.top, t.top), now.left, max(now.bottom, t.bottom), t.right)))
            else:
                rest.append(t)
        out.append(now)
        left = rest
    return out


def forms(grid: Grid, tables: list[Region]) -> list[Region]:
    """Join the narrow pieces of a form that lie side by side."""
    groups: list[list[Region]] = []
    for t in tables:
        for g in groups:
            shared = min(g[0].bottom, t.bottom) - max(g[0].top, t.top) + 1
            if shared > 0 and shared / min(g[0].height, t.height) >= FORM_OVERLAP:
                g.append(t)
                break
        else:
            groups.append([t])
    whole = [g for g in groups if len(g) >= 3 and sum(t.width <= FORM_WIDTH for t in g) >= 3]
    gone = {id(t) for g in whole for t in g}
    made = [sure(grid, describe(grid, Region(min(t.top for t in g), min(t.left for t in g), max(t.bottom for t in g), max(t.right for t in g))), 0.2, 0.85) for g in whole]
    return [t for t in tables if id(t) not in gone] + made


def inherit(tables: list[Region]) -> list[Region]:
    """A table without header takes the labels of the one close above with the same columns."""
    out = sorted(tables, key=lambda t: t.top)
    for i, t in enumerate(out):
        if t.header_rows or t.headers:
            continue
        above = next((a for a in reversed(out[:i]) if (a.left, a.right) == (t.left, t.right) and 0 <= t.top - a.bottom - 1 <= 2 and a.headers), None)
        if above:
            out[i] = replace(t, headers=dict(above.headers), merged_headers=list(above.merged_headers))
    return out


def detect(grid: Grid, threshold: float = 0.7) -> tuple[list[Region], list[tuple[int, int, str, str]]]:
    """Tables in order of confidence, and the cells outside any."""
    occupied = [(r, c) for r, row in grid.rows.items() for c, x in row.items() if x.kind]
    cols = bands({c for _, c in occupied})
    rows = join_bands(grid, bands({r for r, _ in occupied}), cols)
    tables, others = [], []
    for top, bottom in rows:
        for left, right in cols:
            if not any(grid.filled(r, left, right) for r in range(top, bottom + 1)):
                continue
            a, b, cut = trim(grid, top, bottom, left, right)
            others += cut
            if a > b:
                continue
            x = Region(a, left, b, right)
            if x.width == 1:
                others += [(r, c, v.text, "isolated") for r in range(a, b + 1) for c, v in grid.filled(r, left, right)]
            else:
                tables.append(sure(grid, describe(grid, x)))
    tables = inherit(forms(grid, beside(grid, tables)))
    return sorted(tables, key=lambda t: -t.confidence), others


def _grid(pdf: pd.DataFrame) -> Grid:
    cells, merges = {}, []
    for k, r, c, vtype, text, formula, mr, mc, bold, bg, bl, br, r1, c1 in pdf[["kind", "row", "col", "vtype", "vtext", "formula", "m_row", "m_col", "bold", "bg", "border_left", "border_right", "end_row", "end_col"]].itertuples(index=False):
        if k == "merge":
            merges.append((int(r), int(c), int(r1), int(c1)))
        else:
            none = lambda x: None if x is None or x != x else x
            cells[int(r), int(c)] = Cell(none(vtype), none(text), none(formula), None if pd.isna(mr) else (int(mr), int(mc)), bold is True or bold == 1, none(bg), none(bl), none(br))
    return Grid(cells, merges)


LAYOUT = REGION + ", others array<struct<row:int,col:int,text:string,kind:string>>"


def lay_out(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A row per table (REGION) in order of confidence; others are in rows with a null region_ix."""

    ship(records.sparkSession)

    def run(key, pdf):
        tables, others = detect(_grid(pdf), threshold)
        rows = [(key[0], key[1], i, t.top, t.left, t.bottom, t.right, t.header_rows, t.body_start, t.body_end, t.headers, t.merged_headers, t.types, t.stubs, t.confidence, t.confidence < threshold, None) for i, t in enumerate(tables)]
        if others:
            rows.append((key[0], key[1], None, *[None] * 13, [{"row": r, "col": c, "text": t, "kind": k} for r, c, t, k in others]))
        out = pd.DataFrame(rows, columns=["file_id", "sheet_ix", "region_ix", "start_row", "start_col", "end_row", "end_col", "header_rows", "body_start", "body_end", "headers", "merged_headers", "types", "stub_cols", "confidence", "abstain", "others"])
        for c in ("sheet_ix", "region_ix", "start_row", "start_col", "end_row", "end_col", "body_start", "body_end"):
            out[c] = out[c].astype("Int32")
        out["abstain"] = out["abstain"].astype("boolean")
        return out

    slim = records.where(F.col("kind").isin("cell", "merge")).where((F.col("kind") == "merge") | F.col("vtype").isNotNull() | F.col("merged") | F.col("bold") | F.col("border_left").isNotNull() | F.col("border_right").isNotNull())
    return slim.select("file_id", "sheet_ix", "kind", "row", "col", "vtype", "vtext", "formula", "m_row", "m_col", "bold", "bg", "border_left", "border_right", "end_row", "end_col").groupBy("file_id", "sheet_ix").applyInPandas(run, LAYOUT)
