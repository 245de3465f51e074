"""Column helpers with the meaning that Python's str and re give them.

Java's ``\\s`` and ``\\d`` are ASCII unless (?U) is set, and even then white
space lacks U+001C to U+001F, so classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\s\\x1C-\\x1F]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+\\z", "")


def rstrip_of(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"[{chars}]+\\z", "")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?U){pattern}")


def a1(row: Column, col: Column) -> Column:
    """A1 text of a cell; columns up to three letters."""
    c = col - 1
    letter = lambda x: F.char(x + 65)
    one, two = letter(F.pmod(c, F.lit(26))), letter(F.pmod(F.floor(c / 26) - 1, F.lit(26)))
    three = letter(F.pmod(F.floor((c - 26) / 676) - 1, F.lit(26)))
    return F.concat(F.when(c >= 702, three).otherwise(""), F.when(c >= 26, two).otherwise(""), one, row.cast("string"))


def a1_range(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    first, last = a1(r0, c0), a1(r1, c1)
    return F.when((r0 == r1) & (c0 == c1), first).otherwise(F.concat(first, F.lit(":"), last))


#: The shapes of numbers and dates written as text, and marks that stand for a missing value.
NUMBER = r"^[+-]?\d+$|^[+-]?\d+\.\d+$|^[+-]?\d{1,3}(,\d{3})*(\.\d+)?$"
DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$|^\d{1,2}[-/]\d{1,2}[-/]\d{4}$"
MISSING = ["-", "－", "–", "―", "…", "‥", "*", "×", "x", "X", "N/A", "n/a", "NA", "-　"]


def is_number_text(c: Column) -> Column:
    return matches(c, NUMBER)


def is_date_text(c: Column) -> Column:
    return matches(c, DATE)


def is_data_like(c: Column) -> Column:
    """A number that is not a mere column number."""
    return c.contains(",") | c.contains(".") | (F.length(F.regexp_replace(c, "^[+-]+", "")) >= 3)


def value_kind(vtype: Column, vtext: Column) -> Column:
    """numeric, date, text or empty, for the vote on a column's type."""
    s = strip(vtext)
    return (
        F.when(vtype.isNull() | (vtype == "null") | vtext.isNull(), "empty")
        .when(vtype.isin("num", "bool"), "numeric")
        .when(vtype == "date", "date")
        .when(vtype != "str", "text")
        .when((s == "") | s.isin(MISSING), "empty")
        .when(is_date_text(s), "date")
        .when(is_number_text(s), "numeric")
        .otherwise("text")
    )


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def boundaries(c: Column) -> Column:
    """Rows and columns (r0, c0, r1, c1) that a text names: A1, $A$1:C3, A:C, 2:5, R1C1:R2C2, "row 3", "3行", "column C", "C列"; null in open ends and in all for other texts."""
    t = F.upper(F.regexp_replace(strip(c), r"\$", ""))
    part = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    cell, numbered = r"^([A-Z]{1,3})([0-9]{1,7})(?::([A-Z]{1,3})([0-9]{1,7}))?$", r"^R([0-9]{1,7})C([0-9]{1,5})(?::R([0-9]{1,7})C([0-9]{1,5}))?$"
    columns, rows = r"^(?:COLUMNS? ?)?([A-Z]{1,3})(?:列|:([A-Z]{1,3}))?$", r"^(?:ROWS? ?)?([0-9]{1,7})(?:行|:([0-9]{1,7}))?$"
    some = lambda r0, c0, r1, c1: F.struct(r0.cast("int").alias("r0"), c0.cast("int").alias("c0"), F.coalesce(r1, r0).cast("int").alias("r1"), F.coalesce(c1, c0).cast("int").alias("c1"))
    letters = lambda p, i: F.when(part(p, i).isNotNull(), column_number(part(p, i)))
    none = F.lit(None).cast("int")
    return (
        F.when(t.rlike(numbered), some(part(numbered, 1), part(numbered, 2), part(numbered, 3), part(numbered, 4)))
        .when(t.rlike(cell), some(part(cell, 2), letters(cell, 1), part(cell, 4), letters(cell, 3)))
        .when(t.rlike(rows) & t.rlike("[行:R]"), some(part(rows, 1), none, part(rows, 2), none))
        .when(t.rlike(columns) & t.rlike("[列: ]"), some(none, letters(columns, 1), none, letters(columns, 2)))
    )


def iso_duration(seconds: Column) -> Column:
    """ISO 8601 text of a duration in whole seconds, from days down: P1DT2H3M4S; PT0S for none."""
    s = F.abs(seconds.cast("long"))
    days, hours, minutes, rest = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    time = F.concat(text(hours, "H"), text(minutes, "M"), text(rest, "S"))
    out = F.concat(F.lit("P"), text(days, "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.when(out == "P", "PT0S").otherwise(out))
