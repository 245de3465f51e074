"""Files as rows: every cell, merge, reference, object, diagnosis and sheet is a record.

A file is parsed by one task. Records of all kinds share one schema, so a file is
parsed once and the kinds are selections of the same written or cached table.
"""

from __future__ import annotations

import json
import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.model import RECORD
from gridscope.operators.bands import islands
from gridscope.sources import delimited, ooxml

COLUMNS = [c.split()[0] for c in RECORD.replace("\n", " ").split(",")]
SUFFIXES = {"xlsx": "xlsx", "xlsm": "xlsx", "csv": "csv", "tsv": "tsv"}


class UnsupportedFormatError(ValueError):
    pass


def file_format(name: str) -> str:
    """By suffix; others are refused."""
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in SUFFIXES:
        raise UnsupportedFormatError(f"unsupported format: {name}")
    return SUFFIXES[suffix]


def check_content(kind: str, content: bytes) -> str | None:
    """What speaks against the bytes being what the suffix says."""
    if kind == "xlsx":
        return None if content[:4] == b"PK\x03\x04" else "not a workbook package"
    return "binary content" if content[:4] == b"PK\x03\x04" or b"\x00" in content[:65536] else None


def parse(name: str, content: bytes, file_id: str) -> Iterator[dict]:
    """Records of a file; a refused or broken file is one record of kind error."""
    try:
        kind = file_format(name)
        problem = check_content(kind, content)
        if problem:
            raise UnsupportedFormatError(problem)
        yield from (_workbook if kind == "xlsx" else _text)(kind, name, content, file_id)
    except (UnsupportedFormatError, ValueError, KeyError, IndexError, SyntaxError, zlib.error, ooxml.zipfile.BadZipFile) as e:
        yield {"file_id": file_id, "sheet_ix": -1, "kind": "error", "vtext": name, "extra": json.dumps({"error": f"{type(e).__name__}: {e}", "size": len(content)}, ensure_ascii=False)}


def _text(kind: str, name: str, content: bytes, file_id: str) -> Iterator[dict]:
    text, encoding = delimited.decode(content)
    delimiter = "\t" if kind == "tsv" else ","
    rows = delimited.fields(text, delimiter)
    d = delimited.diagnose(text, delimiter)
    key = {"file_id": file_id, "sheet_ix": 0}
    width = max((len(r) for r in rows), default=0)
    about = {"format": kind, "encoding": encoding, "size": len(content), "max_row": len(rows), "max_col": width, "hidden": False, "hidden_rows": [], "hidden_cols": [], "formulas_loaded": False, "objects_loaded": False, "error": None}
    issues = {"records": d.records, "counts": dict(d.counts), "widths": {str(k): v for k, v in d.widths.items()}, "samples": d.samples, "truncated": d.truncated, "abort_reason": d.abort_reason, "confidence": d.confidence}
    yield key | {"kind": "sheet", "vtext": posixpath.splitext(name)[0], "extra": json.dumps(about | {"name": name}, ensure_ascii=False)}
    yield key | {"kind": "diagnosis", "extra": json.dumps(issues, ensure_ascii=False)}
    for r, values in enumerate(rows, 1):
        for c, v in enumerate(values, 1):
            yield key | {"kind": "cell", "row": r, "col": c, "vtype": "str" if v else None, "vtext": v or None, "merged": False, "bold": False, "italic": False}


def _workbook(kind: str, name: str, content: bytes, file_id: str) -> Iterator[dict]:
    for ix, s in enumerate(ooxml.read(content)):
        key = {"file_id": file_id, "sheet_ix": ix}
        about = {
            "format": kind, "encoding": None, "size": len(content), "name": name, "hidden": s.hidden,
            "max_row": max((r for r, _ in s.cells), default=0), "max_col": max((c for _, c in s.cells), default=0), "hidden_rows": sorted(s.hidden_rows), "hidden_cols": sorted(s.hidden_cols),
            "formulas_loaded": s.formula_error is None, "objects_loaded": s.object_error is None, "error": s.formula_error or s.object_error, "row_levels": s.row_levels, "col_levels": s.col_levels,
        }
        yield key | {"kind": "sheet", "vtext": s.name, "extra": json.dumps(about, ensure_ascii=False)}
        master = {}
        for r0, c0, r1, c1 in s.merges:
            yield key | {"kind": "merge", "row": r0, "col": c0, "end_row": r1, "end_col": c1}
            for r in range(r0, min(r1, ooxml.ROWS_MOST) + 1):
                for c in range(c0, min(c1, ooxml.COLS_MOST) + 1):
                    master[r, c] = (r0, c0)
        for r, c in {**dict.fromkeys(s.cells), **dict.fromkeys(master)}:
            vtype, text, number, formula, style = s.cells.get((r, c), (None, None, None, None, ooxml.Style()))
            m = master.get((r, c), (None, None))
            yield key | {
                "kind": "cell", "row": r, "col": c, "vtype": vtype, "vtext": text, "vnum": number, "formula": formula, "merged": m[0] is not None, "m_row": m[0], "m_col": m[1],
                "bold": style.bold, "italic": style.italic, "font": style.font, "bg": style.bg, "number_format": style.number_format, "alignment": style.alignment,
                "border_left": style.border[0], "border_right": style.border[1], "border_top": style.border[2], "border_bottom": style.border[3],
            }
        for what, found in (("formula", s.formulas), ("error_ref", s.errors), ("object", s.objects)):
            for r, c, detail in found:
                yield key | {"kind": what, "row": r, "col": c, "vtext": detail}


_INTS = {"sheet_ix", "row", "col", "m_row", "m_col", "end_row", "end_col"}
_BOOLS = {"merged", "bold", "italic"}


def to_frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    for c in COLUMNS:
        out[c] = out[c].astype("Int32" if c in _INTS else "boolean" if c in _BOOLS else "Float64" if c == "vnum" else object)
    return out.where(out.notna(), None)


def _parse_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in it:
        for path, content in zip(files["path"], files["content"]):
            rows = []
            for r in parse(unquote(path.rsplit("/", 1)[-1]), bytes(content), path):
                rows.append(r)
                if len(rows) == 20_000:
                    yield to_frame(rows)
                    rows = []
            if rows:
                yield to_frame(rows)


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of all files at a path or glob."""
    files = spark.read.format("binaryFile").load(path)
    return parse_files(files)


def parse_files(files: DataFrame) -> DataFrame:
    """Records of files given as rows (path, content); also for streams of files."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(_parse_batches, RECORD)


SHEET = "name string, format string, encoding string, size long, max_row int, max_col int, hidden boolean, hidden_rows array<int>, hidden_cols array<int>, formulas_loaded boolean, objects_loaded boolean, error string"
DIAGNOSIS = "records long, counts map<string,long>, widths map<string,long>, samples array<struct<type:string,severity:string,row:int,line:int,preview:string>>, truncated boolean, abort_reason string, confidence double"


@dataclass
class Workbooks:
    """The kinds of records, as selections of one table."""

    records: DataFrame

    def _kind(self, *kinds: str) -> DataFrame:
        return self.records.where(F.col("kind").isin(*kinds))

    @property
    def cells(self) -> DataFrame:
        return self._kind("cell").drop("kind", "extra", "end_row", "end_col")

    @property
    def sheets(self) -> DataFrame:
        return self._kind("sheet").select("file_id", "sheet_ix", F.col("vtext").alias("sheet"), F.from_json("extra", SHEET).alias("s")).select("file_id", "sheet_ix", "sheet", "s.*")

    @property
    def outlines(self) -> DataFrame:
        """Groups of the outline: runs of rows (axis row) and columns (axis col) of a level above 0."""
        levels = self._kind("sheet").select("file_id", "sheet_ix", F.from_json("extra", "row_levels map<string,int>, col_levels map<string,int>").alias("l"))
        found = levels.select("file_id", "sheet_ix", F.lit("row").alias("axis"), F.explode("l.row_levels").alias("i", "level")).unionByName(levels.select("file_id", "sheet_ix", F.lit("col").alias("axis"), F.explode("l.col_levels").alias("i", "level")))
        return islands(found.where("level > 0").withColumn("i", F.col("i").cast("int")), ["file_id", "sheet_ix", "axis"], "i").drop("island")

    @property
    def errors(self) -> DataFrame:
        return self._kind("error").select("file_id", F.col("vtext").alias("name"), F.get_json_object("extra", "$.error").alias("error"))

    @property
    def merges(self) -> DataFrame:
        return self._kind("merge").select("file_id", "sheet_ix", F.col("row").alias("start_row"), F.col("col").alias("start_col"), "end_row", "end_col")

    @property
    def references(self) -> DataFrame:
        return self._kind("formula", "error_ref", "object").select("file_id", "sheet_ix", "kind", "row", "col", F.col("vtext").alias("detail"))

    @property
    def diagnoses(self) -> DataFrame:
        return self._kind("diagnosis").select("file_id", "sheet_ix", F.from_json("extra", DIAGNOSIS).alias("d")).select("file_id", "sheet_ix", "d.*")
