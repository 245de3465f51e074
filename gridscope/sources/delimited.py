"""Delimited text: cells, and what is wrong with the raw records."""

from __future__ import annotations

import csv
import io
from collections import Counter
from dataclasses import dataclass, field

#: Samples kept in all and of a type, issues after which the scan stops, and the confidence it then has.
SAMPLES_ALL, SAMPLES_TYPE, ISSUES_MOST, CONFIDENCE_CUT = 100, 50, 1000, 0.85
PREVIEW = 500


def decode(content: bytes) -> tuple[str, str]:
    """Text and encoding: a byte-order mark, else UTF-8, else cp932 (bytes that it lacks are replaced)."""
    if content.startswith(b"\xef\xbb\xbf"):
        return content[3:].decode("utf-8", "replace"), "utf-8-sig"
    try:
        return content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return content.decode("cp932", "replace"), "cp932"


def fields(text: str, delimiter: str) -> list[list[str]]:
    """Records as Python's csv reads them; a field of any length is read."""
    csv.field_size_limit(1 << 30)
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))


@dataclass
class Diagnostics:
    records: int = 0
    counts: Counter = field(default_factory=Counter)
    widths: Counter = field(default_factory=Counter)
    samples: list[dict] = field(default_factory=list)
    truncated: bool = False
    abort_reason: str | None = None

    @property
    def confidence(self) -> float:
        return CONFIDENCE_CUT if self.truncated else 1.0

    def add(self, kind: str, severity: str, row: int, line: int, preview: str) -> None:
        self.counts[kind] += 1
        if len(self.samples) < SAMPLES_ALL and sum(s["type"] == kind for s in self.samples) < SAMPLES_TYPE:
            self.samples.append({"type": kind, "severity": severity, "row": row, "line": line, "preview": preview[:PREVIEW]})


def _records(text: str, delimiter: str):
    """(fields, physical lines, fields with a stray quote, whether a quote stays open, raw text) of each record.

    Reads whole runs between the characters that matter, by four states: at a
    field's start, in quotes, behind a closing quote, in plain text.
    """
    start, plain, quoted, behind = range(4)
    state, count, lines, stray, field_stray, begin = start, 1, 1, 0, False, 0
    i, n = 0, len(text)
    pending = False
    while i < n:
        c = text[i]
        pending = True
        if state == quoted:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    state = behind
            elif c == "\n" or (c == "\r" and text[i + 1 : i + 2] != "\n"):
                lines += 1
        elif c == delimiter:
            stray += field_stray
            count, field_stray, state = count + 1, False, start
        elif c in "\r\n":
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            yield count, lines, stray + field_stray, False, text[begin : i + 1]
            state, count, lines, stray, field_stray, begin, pending = start, 1, 1, 0, False, i + 1, False
        elif c == '"':
            if state == start:
                state = quoted
            else:
                field_stray, state = True, plain if state == plain else behind
        elif state == behind:
            field_stray = field_stray or not c.isspace()
        else:
            state = plain
        i += 1
    if pending:
        yield count, lines, stray + field_stray, state == quoted, text[begin:]


def diagnose(text: str, delimiter: str) -> Diagnostics:
    out, first, line = Diagnostics(), None, 1
    for row, (count, lines, stray, opened, raw) in enumerate(_records(text, delimiter), 1):
        out.records = row
        out.widths[count] += 1
        if opened:
            out.add("unclosed_quote", "error", row, line, raw)
        elif lines > 1:
            out.add("multiline_record", "error", row, line, raw)
        for _ in range(stray):
            out.add("unquoted_quote", "error", row, line, raw)
        if first is None:
            first = count
        elif count != first:
            out.add("field_count_mismatch", "warning", row, line, raw)
        line += lines
        if sum(out.counts.values()) > ISSUES_MOST:
            out.truncated, out.abort_reason = True, "too_many_issues"
            break
    return out
