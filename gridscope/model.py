"""Shared schemas, rule metadata and scoring constants."""

from __future__ import annotations

from dataclasses import dataclass

RECORD = """file_id string, sheet_ix int, kind string, row int, col int, vtype string, vtext string, vnum double,
 formula string, merged boolean, m_row int, m_col int, bold boolean, italic boolean, font string, bg string,
 number_format string, alignment string, border_left string, border_right string, border_top string, border_bottom string,
 end_row int, end_col int, extra string"""

REGION = """file_id string, sheet_ix int, region_ix int, start_row int, start_col int, end_row int, end_col int,
 header_rows array<int>, body_start int, body_end int, headers map<int,string>, merged_headers array<int>,
 types map<int,string>, stub_cols array<int>, confidence double, abstain boolean"""

VIOLATION = "file_id string, sheet_ix int, region_ix int, rule_id string, start_row int, start_col int, end_row int, end_col int, severity string, detail string"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    target: str  # common, excel or csv
    severity: str
    confidence: float
    confidence_fail: float | None = None

    @property
    def level(self) -> int:
        return int(self.rule_id[1])


#: Identifier, target format, severity and confidences of each rule.
RULES = [
    Rule("L1-01", "the file is a spreadsheet or delimited text", "common", "fatal", 1.0),
    Rule("L1-02", "a sheet holds one table", "common", "fatal", 0.85),
    Rule("L1-03", "a table is not broken up by blank rows or columns", "common", "critical", 0.85, 0.9),
    Rule("L1-04", "nothing but the table stands on the sheet", "common", "major", 0.9),
    Rule("L1-05", "each column has a name", "common", "critical", 0.8, 0.85),
    Rule("L1-06", "white space is not used for layout", "common", "critical", 0.95),
    Rule("L1-07", "a cell holds one datum", "common", "critical", 0.82, 0.78),
    Rule("L1-08", "no platform-dependent characters", "common", "critical", 0.95),
    Rule("L1-09", "blank and zero are told apart", "common", "minor", 0.0),
    Rule("L1-10", "no drawing objects in the table", "excel", "critical", 1.0),
    Rule("L1-11", "formats carry no meaning", "excel", "critical", 0.75),
    Rule("L1-12", "no merged cells", "excel", "critical", 1.0),
    Rule("L1-13", "no hidden rows or columns", "excel", "critical", 1.0),
    Rule("L1-14", "a record is one line", "csv", "fatal", 1.0),
    Rule("L1-15", "fields are quoted where needed", "csv", "fatal", 1.0),
    Rule("L2-01", "numeric columns hold numbers", "common", "fatal", 0.85),
    Rule("L2-02", "items are not abbreviated", "common", "fatal", 0.7),
    Rule("L2-03", "column names are unique", "common", "fatal", 0.95),
    Rule("L2-04", "choices are spelt alike", "common", "critical", 0.7),
    Rule("L2-05", "details of other answers have their own column", "common", "major", 0.8),
    Rule("L2-06", "formulas are converted to values", "excel", "major", 1.0),
    Rule("L3-01", "the header starts in the first row", "common", "fatal", 0.95),
    Rule("L3-02", "codes have a code table", "common", "critical", 0.0),
    Rule("L3-03", "special symbols are explained", "common", "major", 0.0),
    Rule("L3-04", "numeric columns name their unit", "common", "major", 0.65),
    Rule("L3-05", "time is written in a standard form", "common", "major", 0.75),
    Rule("L3-06", "regions have standard codes and names", "common", "critical", 0.7),
    Rule("L3-07", "files of a series share their format", "common", "critical", 0.0, 0.8),
    Rule("L3-08", "metadata is given", "common", "major", 0.0),
    Rule("L3-09", "the table is in long form", "common", "major", 0.7),
]
RULE = {r.rule_id: r for r in RULES}

#: Points taken by (level, severity); a failed rule of a forced-zero severity makes the score 0.
DEDUCTIONS = {
    (1, "critical"): 10, (1, "major"): 5, (1, "minor"): 2, (1, "info"): 0,
    (2, "critical"): 40, (2, "major"): 30, (2, "minor"): 10, (2, "info"): 0,
    (3, "critical"): 15, (3, "major"): 10, (3, "minor"): 5, (3, "info"): 0,
}
FORCED_ZERO = frozenset({"fatal"})
MODES = {"lite": (1,), "standard": (1, 2), "thorough": (1, 2, 3)}
FORMATS = ("xlsx", "csv", "tsv")
#: Violations of one check beyond which reports show groups.
SUMMARISE_ABOVE, SAMPLES = 20, 3
