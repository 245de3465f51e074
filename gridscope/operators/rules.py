"""The rules, as DataFrame plans over cells and table regions.

A rule gives violations, and where its verdict is not simply "none found" also a
status per region. Joins of cells and regions are equal on (file_id, sheet_ix)
with the rectangle as residual, so they are hash or merge joins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gridscope.functions import text as T
from gridscope.functions.regions import dictionary
from gridscope.model import RULE, VIOLATION
from gridscope.operators.bands import islands, missing_indices
from gridscope.operators.lineage import cut
from gridscope.semantic import SURE, NoProvider

KEY = ["file_id", "sheet_ix"]
REGION_KEY = [*KEY, "region_ix"]


@dataclass
class Context:
    cells: DataFrame
    sheets: DataFrame
    merges: DataFrame
    references: DataFrame
    diagnoses: DataFrame
    regions: DataFrame
    others: DataFrame
    regions_dictionary: DataFrame | None = None
    cut: bool = False  # whether what most rules read is written once
    semantic: object = field(default_factory=NoProvider)

    def sure(self, kind: str, candidates: DataFrame) -> DataFrame | None:
        """The candidates of which a language model is sure; None without one."""
        return self.semantic.ask(kind, candidates).where(F.col("confidence") >= SURE) if self.semantic.available() else None

    @cached_property
    def inside(self) -> DataFrame:
        """Cells of regions, with what the region knows about their column."""
        r = self.regions.select(*REGION_KEY, "start_row", "end_row", "start_col", "end_col", "header_rows", "body_start", "body_end", "headers", "types", "stub_cols", "abstain")
        c = self.cells.join(r, KEY).where(F.col("row").between(F.col("start_row"), F.col("end_row")) & F.col("col").between(F.col("start_col"), F.col("end_col")))
        c = (
            c.withColumn("s", F.coalesce(T.strip(F.col("vtext")), F.lit("")))
            .withColumn("has_value", F.col("vtype").isNotNull())
            .withColumn("label", F.try_element_at("headers", F.col("col")))
            .withColumn("ctype", F.try_element_at("types", F.col("col")))
            .withColumn("body", F.col("row").between(F.col("body_start"), F.col("body_end")))
            .withColumn("last_header", F.when(F.size("header_rows") > 0, F.try_element_at("header_rows", F.lit(-1))))
            .drop("headers", "types")
        )
        return cut(c) if self.cut else c

    @cached_property
    def body(self) -> DataFrame:
        return self.inside.where("body and has_value and s <> ''")

    @cached_property
    def heads(self) -> DataFrame:
        """Values of the last header row."""
        return self.inside.where((F.col("row") == F.col("last_header")) & F.col("has_value") & (F.col("s") != ""))


def violations(df: DataFrame, rule: str, severity: Column | str, detail: Column, r0="row", c0="col", r1=None, c1=None) -> DataFrame:
    column = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(
        *REGION_KEY, F.lit(rule).alias("rule_id"), column(r0).cast("int").alias("start_row"), column(c0).cast("int").alias("start_col"), column(r1 if r1 is not None else r0).cast("int").alias("end_row"), column(c1 if c1 is not None else c0).cast("int").alias("end_col"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), detail.alias("detail"),
    )


def status(df: DataFrame, rule: str, passed: Column | None = None, confidence: Column | float | None = None, severity: Column | None = None) -> DataFrame:
    put = lambda x, t: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast(t)
    return df.select(*REGION_KEY, F.lit(rule).alias("rule_id"), put(passed, "boolean").alias("passed"), put(confidence, "double").alias("confidence"), put(severity, "string").alias("severity"))


Result = tuple[DataFrame | None, DataFrame | None]
REGISTRY: dict[str, Callable[[Context], Result]] = {}


def rule(rule_id: str):
    def add(f):
        REGISTRY[rule_id] = f
        return f

    return add


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


@rule("L1-01")
def format_known(x: Context) -> Result:
    bad = x.regions.join(x.sheets.where(~F.col("format").isin("xlsx", "csv", "tsv")).select(*KEY), KEY)
    return violations(bad, "L1-01", "error", F.lit("unknown format"), "start_row", "start_col"), None


@rule("L1-02")
def one_table(x: Context) -> Result:
    w = Window.partitionBy(*KEY)
    r = x.regions.withColumn("sure", F.max((F.col("confidence") >= 0.5).cast("int")).over(w))
    r = r.where((F.col("sure") == 0) | (F.col("confidence") >= 0.5)).withColumn("n", F.count("*").over(w)).withColumn("region_ix", F.min("region_ix").over(w))
    return violations(r.where("n > 1"), "L1-02", "warning", F.lit("one of several tables"), "start_row", "start_col", "end_row", "end_col"), None


@rule("L1-03")
def fragments(x: Context) -> Result:
    tall = x.regions.where("end_row - start_row + 1 > 2")
    said = x.inside.where("has_value and s <> ''")
    rows = missing_indices(tall, said, REGION_KEY, "row", F.col("start_row"), F.col("end_row"), ("start_col", "end_col"))
    cols = missing_indices(tall, said, REGION_KEY, "col", F.col("start_col"), F.col("end_col"), ("start_row", "end_row"))
    slaves = x.inside.where(F.col("m_col").isNotNull() & (F.col("m_col") != F.col("col"))).groupBy(*REGION_KEY, "col").agg(F.countDistinct("row").alias("slaves"))
    cols = cols.join(slaves, [*REGION_KEY, "col"], "left").where(F.coalesce("slaves", F.lit(0)) < F.col("end_row") - F.col("start_row") + 1)
    order = Window.partitionBy(*KEY).orderBy("start_row", "start_col")
    gaps = x.regions.select(*KEY, "region_ix", "start_row", "end_row", "start_col", "end_col", F.lead("start_row").over(order).alias("next"), F.first("region_ix").over(order).alias("top"))
    gaps = gaps.where("next > end_row + 1").select(*KEY, F.col("top").alias("region_ix"), "start_col", "end_col", F.explode(F.sequence(F.col("end_row") + 1, F.col("next") - 1)).alias("row"))
    gaps = gaps.join(x.cells.where(T.strip(F.col("vtext")) != "").select(*KEY, "row").distinct(), [*KEY, "row"], "left_anti")
    return _union(
        violations(rows, "L1-03", "error", F.lit("blank row"), "row", "start_col", "row", "end_col"),
        violations(cols, "L1-03", "error", F.lit("blank column"), "start_row", "col", "end_row", "col"),
        violations(gaps, "L1-03", "error", F.lit("blank row between tables"), "row", "start_col", "row", "end_col"),
    ), None


@rule("L1-04")
def strays(x: Context) -> Result:
    met = x.regions.select(*REGION_KEY).join(x.others, KEY)
    return violations(met, "L1-04", "warning", F.concat(F.lit("outside the table: "), F.coalesce("kind", F.lit("")))), None


@rule("L1-05")
def names(x: Context) -> Result:
    first = F.when(F.size("header_rows") > 0, F.try_element_at("header_rows", F.lit(1))).otherwise(F.col("start_row"))
    cols = x.regions.select(*REGION_KEY, first.alias("row"), "headers", "header_rows", F.explode(F.sequence("start_col", "end_col")).alias("col"))
    top = x.inside.where((F.size("header_rows") == 0) & (F.col("row") == F.col("start_row"))).select(*REGION_KEY, "col", F.col("s").alias("said"))
    full = x.body.select(*REGION_KEY, "col").distinct().withColumn("full", F.lit(True))
    cols = cols.join(top, [*REGION_KEY, "col"], "left").join(full, [*REGION_KEY, "col"])
    name = F.coalesce(F.when(F.size("header_rows") > 0, F.try_element_at("headers", F.col("col"))), F.col("said"), F.lit(""))
    unnamed = violations(cols.where(name == ""), "L1-05", "error", F.lit("column without a name"))
    last = x.inside.where(F.col("row") == F.coalesce("last_header", F.col("start_row")))
    number = F.when(F.col("vtype") == "num", F.col("vnum")).when(F.col("s").rlike(r"^[+-]?\d+(\.0+)?$"), F.col("s").try_cast("double"))
    last = last.withColumn("number", number)
    step = last.groupBy(*REGION_KEY).agg(F.max(F.col("end_col") - F.col("start_col") + 1).alias("width"), F.count("number").alias("n"), F.min(F.col("number") - F.col("col")).alias("a"), F.max(F.col("number") - F.col("col")).alias("b")).where("n >= 2 and n = width and a = b and a = floor(a)")
    counted = violations(last.join(step.select(*REGION_KEY), REGION_KEY), "L1-05", "error", F.lit("running number instead of a name"))
    return _union(unnamed, counted), None


#: Headers of address columns, and meaningful uses of ideographic spaces.
ADDRESS = r"(?i)(住所|所在地|address|addr|勤務地|居所|連絡先住所|本籍|現住所|送付先)"
MEANT = "|".join([
    r"^[ア-ンa-zａ-ｚ①-⑳（\(][）\)]?\x{3000}", r"^※\d*\x{3000}", r"^第[０-９0-9一二三四五六七八九十]+\x{3000}", r"^\x{3000}+〃$", r"^\x{3000}+[○●・◯]\x{3000}?",
    r"^\[.+?\]\x{3000}?[0-9０-９]", r"^[\x{2160}-\x{217F}][．.]\x{3000}?", r"^[0-9０-９]+[．.]\x{3000}", r"^\x{3000}{2,}[0-9０-９]+[．.]", r"\([A-Za-z]\)/\([A-Za-z]\)\x{3000}",
])


def whitespace_issues(c: Column, address: Column | None = None) -> Column:
    """Kinds of layout white space in a text, in a fixed order."""
    address = F.lit(False) if address is None else address
    meant = T.matches(c, MEANT)
    tail = T.rstrip_of(c, r"\n")
    inner = T.rstrip_of(c, r"\r\n").rlike(r"[\r\n]")
    density = F.regexp_count(c, F.lit(f"(?U){T.SPACE}")) / F.greatest(F.length(c), F.lit(1))
    tests = [("edge", (tail != T.strip(tail)) & ~meant), ("wide", ~address & c.contains("　") & ~meant), ("run", ~address & T.strip(c).rlike("[ \\x{3000}]{2,}") & ~meant), ("newline", inner & (density > 0.10))]
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests]))


@rule("L1-06")
def whitespace(x: Context) -> Result:
    c = x.inside.where("vtype = 'str'").withColumn("found", whitespace_issues(F.col("vtext"), F.coalesce(F.col("label").rlike(ADDRESS), F.lit(False))))
    return violations(c.where(F.size("found") > 0), "L1-06", "warning", F.array_join("found", ",")), None


def several_data(c: Column, ctype: Column | None = None) -> Column:
    """Why a text holds more than one datum; null if it doesn't."""
    thousands = r"^\d{1,3}(,\d{3})*(\.\d+)?$"
    s = T.strip(c)
    lines = F.size(F.filter(F.split(c, "\n"), lambda p: T.strip(p) != ""))
    compact = F.regexp_replace(F.regexp_replace(c, f"(?U){T.SPACE}+", ""), "（[^）]*）", "")
    other = F.lit(True) if ctype is None else ~ctype.eqNullSafe(F.lit("numeric"))
    count = lambda mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    return (
        F.when(c.contains("\n") & (lines >= 2), "lines")
        .when(T.matches(c, r"^\s*\d+（\d+）\s*$"), "two measures")
        .when(count("、") >= 2, "enumeration")
        .when(count("・") >= 2, "enumeration by dots")
        .when(T.matches(c, r"(?<!\d),(?!\d)") & ~T.matches(s, thousands), "commas")
        .when(other & compact.contains(",") & ~T.matches(compact, thousands), "commas")
    )


@rule("L1-07")
def one_datum(x: Context) -> Result:
    c = x.inside.where("vtype = 'str'").withColumn("why", several_data(F.col("vtext"), F.col("ctype")))
    return violations(c.where("why is not null"), "L1-07", "warning", F.col("why")), None


#: Characters by class.
CIRCLED, ROMAN, WIDE = r"[\x{2460}-\x{2473}\x{3251}-\x{325F}\x{32B1}-\x{32BF}]", r"[\x{2160}-\x{217F}]", r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]"
UNITS = "㎡㎥㎢㎠㎝㎞㎜㎏㎎㎍㎅㎄㎃㎖㎗㎘㏄㏊"
PLATFORM = r"[\x{3220}-\x{3243}\x{3280}-\x{32FF}\x{3300}-\x{33FF}\x{FE30}-\x{FE4F}〜～&&[^" + UNITS + "]]"


def platform_severity(c: Column) -> Column:
    """warning, info or null for the platform-dependent characters of a text."""
    code = T.matches(T.strip(c), r"^[Ⅰ-ⅿ][ー－\-][０-９0-9]+$")
    return F.when(c.rlike(CIRCLED) | c.rlike(PLATFORM) | (c.rlike(ROMAN) & ~code), "warning").when(c.rlike(WIDE) | c.rlike(ROMAN), "info")


@rule("L1-08")
def platform_characters(x: Context) -> Result:
    c = x.inside.where("vtype = 'str'").withColumn("found", platform_severity(F.col("vtext"))).where("found is not null")
    found = violations(c, "L1-08", F.col("found"), F.lit("platform-dependent character"))
    bad = c.where("found = 'warning'").join(x.sheets.where("encoding = 'cp932'").select(*KEY), KEY).select(*REGION_KEY).distinct().withColumn("bad", F.lit(True))
    return found, status(x.regions.join(bad, REGION_KEY, "left"), "L1-08", passed=F.col("bad").isNull())


def zero_candidates(x: Context) -> DataFrame:
    """Numeric columns with blanks and zeros, where blank might mean zero; a semantic provider decides."""
    cols = x.regions.where("body_end - body_start + 1 >= 3").select(*REGION_KEY, (F.col("body_end") - F.col("body_start") + 1).alias("rows"), "headers", F.explode(F.sequence("start_col", "end_col")).alias("col"))
    cols = cols.withColumn("head", F.try_element_at("headers", F.col("col"))).drop("headers")
    number = F.coalesce(F.when(F.col("vtype").isin("num", "bool"), F.col("vnum")), F.replace(F.col("s"), F.lit(","), F.lit("")).try_cast("double"))
    n = x.body.groupBy(*REGION_KEY, "col").agg(F.count("*").alias("filled"), F.count(number).alias("numbers"), F.count_if(number == 0).alias("zeros"))
    return cols.join(n, [*REGION_KEY, "col"]).where("numbers >= 0.7 * filled and rows > filled and zeros >= 2")


@rule("L1-09")
def blank_or_zero(x: Context) -> Result:
    low = x.sure("zero_unlikely", zero_candidates(x))
    if low is None:
        return None, status(x.regions, "L1-09", confidence=0.0)
    found = low.select(*REGION_KEY, "col").join(x.regions.select(*REGION_KEY, "body_start", "body_end"), REGION_KEY)
    sure = F.when(F.col("body_end") - F.col("body_start") + 1 >= 3, 0.8).otherwise(0.0)
    return violations(found, "L1-09", "warning", F.lit("blanks beside zeros"), "body_start", "col", "body_end", "col"), status(x.regions, "L1-09", confidence=sure)


@rule("L1-10")
def objects(x: Context) -> Result:
    o = x.references.where("kind = 'object'").join(x.regions, KEY).where(F.col("abstain") | (F.col("row").between(F.col("start_row"), F.col("end_row")) & F.col("col").between(F.col("start_col"), F.col("end_col"))))
    skipped = x.regions.join(x.sheets.where("not objects_loaded").select(*KEY), KEY)
    return violations(o, "L1-10", "error", F.col("detail")), status(skipped, "L1-10", passed=F.lit(True), confidence=0.0)


@rule("L1-11")
def formats(x: Context) -> Result:
    white = F.coalesce(F.col("bg"), F.lit("FFFFFFFF"))
    n = x.body.groupBy(*REGION_KEY, "col").agg(
        F.count("*").alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.countDistinct(F.coalesce("font", F.lit(""))).alias("fonts"), F.count("font").alias("coloured"), F.countDistinct(white).alias("fills"),
        F.count_if(F.col("bold")).alias("bold"), F.count_if(F.col("italic")).alias("italic"),
    ).where("n >= 2")
    tests = [("fonts >= 2 and coloured >= 1", "warning", "font colours"), ("fills >= 2", "warning", "fills"), ("bold > 0 and bold < n", "info", "bold type in places"), ("italic > 0 and italic < n", "info", "italic type in places")]
    return _union(*[violations(n.where(t), "L1-11", s, F.lit(d), "r0", "col", "r1", "col") for t, s, d in tests]), None


@rule("L1-12")
def merged(x: Context) -> Result:
    m = x.merges.select(*KEY, F.col("start_row").alias("a"), F.col("start_col").alias("b"), F.col("end_row").alias("c"), F.col("end_col").alias("d"))
    m = m.join(x.regions, KEY).where("a <= end_row and c >= start_row and b <= end_col and d >= start_col")
    m = m.withColumn("head", F.size(F.array_except(F.sequence("a", "c"), F.coalesce("header_rows", F.array().cast("array<int>")))) == 0)
    kinds = m.groupBy(*REGION_KEY).agg(F.bool_and("head").alias("head"))
    verdict = status(kinds, "L1-12", passed=F.col("head"), severity=F.when(F.col("head"), "major").otherwise("fatal"))
    return violations(m, "L1-12", F.when(F.col("head"), "info").otherwise("error"), F.lit("merged cells"), "a", "b", "c", "d"), verdict


@rule("L1-13")
def hidden(x: Context) -> Result:
    def runs(what: str, most: str) -> DataFrame:
        h = x.sheets.select(*KEY, "max_row", "max_col", F.explode(what).alias("i")).where(F.col("i") <= F.col(most))
        return islands(h, [*KEY, "max_row", "max_col"], "i")

    rows = x.regions.select(*REGION_KEY).join(runs("hidden_rows", "max_row"), KEY)
    cols = x.regions.select(*REGION_KEY).join(runs("hidden_cols", "max_col"), KEY)
    return _union(
        violations(rows, "L1-13", "error", F.lit("hidden rows"), "start", F.lit(1), "end", "max_col"),
        violations(cols, "L1-13", "error", F.lit("hidden columns"), F.lit(1), "start", "max_row", "end"),
    ), None


def _raw(x: Context, rule_id: str, kinds: list[str]) -> Result:
    met = x.regions.join(x.diagnoses, KEY, "left").drop("confidence").join(x.diagnoses.select(*KEY, F.col("confidence").alias("sure")), KEY, "left")
    n = sum((F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)) for k in kinds), F.lit(0))
    verdict = status(met, rule_id, passed=F.coalesce(n == 0, F.lit(True)), confidence=F.when(F.col("records").isNull(), 0.0).otherwise(F.col("sure")))
    issues = met.select(*REGION_KEY, "start_row", "end_row", "start_col", "end_col", F.explode("samples").alias("i")).where(F.col("i.type").isin(kinds) & F.col("i.row").between(F.col("start_row"), F.col("end_row")))
    return violations(issues, rule_id, F.col("i.severity"), F.col("i.type"), F.col("i.row"), "start_col", F.col("i.row"), "end_col"), verdict


@rule("L1-14")
def single_line(x: Context) -> Result:
    return _raw(x, "L1-14", ["multiline_record", "unclosed_quote"])


@rule("L1-15")
def quoting(x: Context) -> Result:
    return _raw(x, "L1-15", ["unquoted_quote", "unclosed_quote", "field_count_mismatch"])


#: Numbers with units, percent signs, notes and triangles.
UNIT = r"([\d,.]+)\s*(人|件|円|千円|百万円|億円|万|千|kg|km|m|g|t|ha|㎡|個|台|回|本|枚|箇所|か所|世帯|戸|社|校|棟|隻|機|両|組|点|冊|食|泊|日|月|年|時間|分|秒|歳|才|度|号|丁目)$"
PERCENT_UNIT, NOTED = r"([\d,.]+)\s*(%|％)$", r"^([\d,.]+)\s*[\(（].*[\)）]$"
LOOSE, STRICT, TRIANGLE = r"^[\s\-ー−▲△▼]*[\d,]+\.?\d*\s*$", r"^[\s\-ー−]*[\d,]+\.?\d*\s*$", r"^[▲△▼]\s*[\d,]+\.?\d*\s*$"
NO_DIGIT, PERCENT = r"^[^\d]+$", r"^[\s\-ー−▲△▼]*[\d,.]+\s*(%|％)\s*$"


def impurity(s: Column, percent_column: Column) -> Column:
    """Why a value of a numeric column is no number; null if it is one or a mark without digits."""
    fine = T.matches(s, STRICT) | T.matches(s, NO_DIGIT) | (percent_column & T.matches(s, PERCENT))
    return F.when(fine, None).when(T.matches(s, TRIANGLE), "triangle").when(T.matches(s, "^" + UNIT), "unit").when(T.matches(s, "^" + PERCENT_UNIT), "percent").when(T.matches(s, NOTED), "note").otherwise("other")


def numberish(vtype: Column, s: Column) -> Column:
    return vtype.isin("num", "bool") | T.matches(s, LOOSE) | T.matches(s, "^" + UNIT) | T.matches(s, "^" + PERCENT_UNIT) | T.matches(s, NOTED)


@rule("L2-01")
def numeric_purity(x: Context) -> Result:
    c = x.body.where(F.col("ctype").isin("numeric", "mixed") | F.col("ctype").isNull())
    n = c.groupBy(*REGION_KEY, "col").agg(F.first("ctype").alias("t"), F.count("*").alias("n"), F.count_if(numberish(F.col("vtype"), F.col("s"))).alias("numbers"), F.count_if(T.matches(F.col("s"), PERCENT)).alias("percents"))
    n = n.where("t = 'numeric' or numbers > 0.5 * n").select(*REGION_KEY, "col", (F.col("percents") >= 0.5 * F.col("n")).alias("percent"))
    c = c.join(n, [*REGION_KEY, "col"]).where(~F.col("vtype").isin("num", "bool")).withColumn("why", impurity(F.col("s"), F.col("percent")))
    found = violations(c.where("why is not null"), "L2-01", F.when(F.col("why") == "note", "warning").otherwise("error"), F.col("why"))
    more = x.sure("unit_cells", c.where("why is null").select(*REGION_KEY, "row", "col", "s"))
    return found if more is None else found.unionByName(violations(more, "L2-01", "error", F.lit("unit"))), None


#: Marks for "as above".
DITTO = ["〃", "同上", "同左", "同右", "〇", "仝", "ヽ", "々"]


def after_value(value: Column, marker: Column, by: list, order: str) -> Column:
    """Whether an earlier row of the group has a value that is no marker."""
    seen = F.max(((value != "") & ~marker).cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(seen, F.lit(0)) == 1


@rule("L2-02")
def abbreviation(x: Context) -> Result:
    dense = x.regions.where("size(stub_cols) > 0").select(*REGION_KEY, F.explode("stub_cols").alias("col"), "body_start", "body_end").select(*REGION_KEY, "col", F.explode(F.sequence("body_start", "body_end")).alias("row"))
    c = dense.join(x.inside.select(*REGION_KEY, "row", "col", "s"), [*REGION_KEY, "row", "col"], "left").withColumn("s", F.coalesce("s", F.lit(""))).withColumn("ditto", F.col("s").isin(DITTO))
    c = c.withColumn("after", after_value(F.col("s"), F.col("ditto"), [*REGION_KEY, "col"], "row"))
    found = _union(violations(c.where("ditto"), "L2-02", "error", F.col("s")), violations(c.where("s = '' and after"), "L2-02", "warning", F.lit("blank for the value above")))
    more = x.sure("abbreviations", c.where((F.col("s") != "") & ~F.col("ditto")).join(x.regions.select(*REGION_KEY, "body_start"), REGION_KEY).where(F.col("row") < F.col("body_start") + 50).select(*REGION_KEY, "row", "col", "s"))
    found = found if more is None else found.unionByName(violations(more, "L2-02", "warning", F.col("s")))
    return found, status(x.regions.where("coalesce(size(stub_cols), 0) <= 0"), "L2-02", passed=F.lit(True), confidence=0.0)


@rule("L2-03")
def unique_names(x: Context) -> Result:
    cells = x.inside.where(F.array_contains("header_rows", F.col("row")) & F.col("m_row").isNotNull() & ((F.col("m_row") != F.col("row")) | (F.col("m_col") != F.col("col"))))
    slaves = cells.select(*REGION_KEY, "col", F.col("m_row").alias("a"), F.col("m_col").alias("b")).distinct()
    ranges = slaves.join(x.merges.select(*KEY, F.col("start_row").alias("a"), F.col("start_col").alias("b"), "end_row", "end_col"), [*KEY, "a", "b"]).select(*REGION_KEY, "a", "b", "end_row", "end_col").distinct()
    cols = x.regions.where("size(header_rows) > 0").select(*REGION_KEY, F.try_element_at("header_rows", F.lit(1)).alias("row"), F.explode("headers").alias("col", "name"))
    cols = cols.join(slaves.select(*REGION_KEY, "col").distinct(), [*REGION_KEY, "col"], "left_anti")
    full = x.body.select(*REGION_KEY, "col").distinct()
    twice = cols.where("name <> ''").withColumn("n", F.count("*").over(Window.partitionBy(*REGION_KEY, "name"))).where("n > 1")
    found = _union(
        violations(ranges, "L2-03", "error", F.lit("merged header"), "a", "b", "end_row", "end_col"),
        violations(cols.where("name = ''").join(full, [*REGION_KEY, "col"]), "L2-03", "error", F.lit("column without a name")),
        violations(twice, "L2-03", "error", F.concat(F.lit("repeated name: "), F.col("name"))),
    )
    return found, status(x.regions.where("coalesce(size(header_rows), 0) <= 0"), "L2-03", passed=F.lit(True), confidence=0.4)


#: Bounds of a choice column, and of rare and similar answers.
CHOICES_MOST, CHOICE_ROWS, RARE_COUNT, RARE_SHARE, SIMILAR, OTHER, OTHER_COUNT = 20, 20, 2, 0.05, 0.75, "その他", 3


def choice_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of choice columns with counts, first rows and whether they are rare."""
    w = Window.partitionBy(*by)
    v = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min("row").alias("row"))
    v = v.withColumn("rows", F.sum("n").over(w)).withColumn("kinds", F.count("*").over(w)).where(f"rows >= {CHOICE_ROWS} and kinds <= {CHOICES_MOST}")
    return v.withColumn("rare", (F.col("n") <= RARE_COUNT) & (F.col("n") / F.col("rows") <= RARE_SHARE))


@F.pandas_udf(BooleanType())
def same_choice(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two answers are one but for width, notes behind it or a slip."""
    import re

    note = re.compile(r"(?<=\S)[\s　]*[※＊＃#（(「【].*$")
    plain = lambda s: note.sub("", unicodedata.normalize("NFKC", s)).strip()

    def alike(x: str, y: str) -> bool:
        x, y = plain(x), plain(y)
        return x == y or min(len(x), len(y)) >= 2 and SequenceMatcher(None, x, y).ratio() >= SIMILAR

    return pd.Series([alike(x, y) for x, y in zip(a, b)])


def _choices(x: Context) -> DataFrame:
    return choice_values(x.body.where("coalesce(ctype, 'text') not in ('numeric', 'date', 'empty')"), [*REGION_KEY, "col"], "s")


@rule("L2-04")
def choice_variants(x: Context) -> Result:
    v = _choices(x)
    usual = v.where(~F.col("rare")).select(*REGION_KEY, "col", F.col("s").alias("usual"))
    pairs = v.where("rare").join(usual, [*REGION_KEY, "col"])  # at most 20 values a column
    met = pairs.where(same_choice("s", "usual")).select(*REGION_KEY, "col", "row", "s", "usual")
    more = x.sure("variants", pairs.select(*REGION_KEY, "col", "row", "s", "usual"))
    met = met if more is None else met.unionByName(more.drop("confidence"))
    met = met.groupBy(*REGION_KEY, "col", "row", "s").agg(F.min("usual").alias("usual"))
    none = x.regions.join(v.select(*REGION_KEY).distinct(), REGION_KEY, "left_anti")
    return violations(met, "L2-04", "warning", F.concat_ws(" ~ ", "s", "usual")), status(none, "L2-04", passed=F.lit(True), confidence=0.0)


def other_details(values: DataFrame, by: list[str], value: str, other: str = OTHER) -> DataFrame:
    """Rare answers with the word for "other", where it comes in several."""
    o = values.where(F.col(value).contains(other)).withColumn("forms", F.count("*").over(Window.partitionBy(*by)))
    return o.where(f"forms >= 2 and n < {OTHER_COUNT}")


@rule("L2-05")
def other_answers(x: Context) -> Result:
    v = _choices(x)
    none = x.regions.join(v.select(*REGION_KEY).distinct(), REGION_KEY, "left_anti")
    found = other_details(v, [*REGION_KEY, "col"], "s").select(*REGION_KEY, "col", "row", "s")
    more = x.sure("other_details", v.where("rare").select(*REGION_KEY, "col", "row", "s"))
    found = found if more is None else found.unionByName(more.drop("confidence")).distinct()
    return violations(found, "L2-05", "warning", F.col("s")), status(none, "L2-05", passed=F.lit(True), confidence=0.0)


@rule("L2-06")
def formulas(x: Context) -> Result:
    def within(df: DataFrame) -> DataFrame:
        return df.join(x.regions.select(*REGION_KEY, "start_row", "end_row", "start_col", "end_col"), KEY).where(F.col("row").between(F.col("start_row"), F.col("end_row")) & F.col("col").between(F.col("start_col"), F.col("end_col")))

    refs = x.references.where("kind in ('formula', 'error_ref')").groupBy(*KEY, "row", "col").agg(F.min("kind").alias("kind"))  # an error hides its formula
    skipped = x.regions.join(x.sheets.where("not formulas_loaded").select(*KEY), KEY)
    return violations(within(refs), "L2-06", "error", F.col("kind")), status(skipped, "L2-06", passed=F.lit(True), confidence=0.0)


@rule("L3-01")
def header_first(x: Context) -> Result:
    last = F.try_element_at("header_rows", F.lit(-1))
    r = x.regions
    low, gap, deep = r.where("start_row > 1"), r.where((F.size("header_rows") > 0) & (F.col("body_start") > last + 1)), r.where("size(header_rows) >= 3")
    found = _union(
        violations(low, "L3-01", "error", F.lit("does not start in the first row"), "start_row", "start_col", "start_row", "end_col"),
        violations(gap, "L3-01", "error", F.lit("rows between header and body"), last + 1, "start_col", F.col("body_start") - 1, "end_col"),
        violations(deep, "L3-01", "info", F.lit("three header rows or more"), F.try_element_at("header_rows", F.lit(1)), "start_col", last, "end_col"),
    )
    fatal = (F.col("start_row") > 1) | F.coalesce((F.size("header_rows") > 0) & (F.col("body_start") > last + 1), F.lit(False))
    return found, status(r, "L3-01", severity=F.when(fatal, "fatal").otherwise("major"))


def _skipped(rule_id: str):
    REGISTRY[rule_id] = lambda x: (None, status(x.regions, rule_id, passed=F.lit(True), confidence=0.0))


for _id in ("L3-02", "L3-03", "L3-07", "L3-08"):
    _skipped(_id)

#: Units in brackets, words that imply a unit, endings that do, and words that need none.
BRACKET_UNIT = r"[（(](人|件|円|千円|百万円|億円|万円|%|％|kg|km|m|cm|mm|g|t|ha|㎡|㎢|個|台|回|本|枚|箇所|か所|世帯|戸|社|校|棟|隻|機|両|組|点|冊|食|泊|日|月|年|時間|分|秒|歳|才|度|kW|kWh|MW|GW|L|mL|dL)[）)]"
IMPLIES_UNIT = "金額 価格 費用 コスト 売上 収入 支出 人口 人数 従業員数 利用者数 面積 距離 長さ 高さ 幅 重量 重さ 質量 割合 率 比率 構成比 年齢 年数 温度 気温".split()
UNIT_ENDINGS = "件数 枚数 回数 か所数 箇所数 人数 数".split()
NEEDS_NONE = "コード code 番号 No ID 指数 指標 順位 ランク フラグ 区分".split()
NEEDS_NONE_TOKENS = "id code key name type flag status index sort rank order level class year month date fiscal_year survey_year number count cnt num no row col seq version is has will can use".split()


def names_unit(h: Column) -> Column:
    """Whether a column name gives, implies or does not need a unit."""
    tokens = F.split(F.replace(F.lower(h), F.lit("-"), F.lit("_")), "_")
    return h.rlike(BRACKET_UNIT) | h.rlike("|".join(IMPLIES_UNIT)) | h.rlike("(" + "|".join(UNIT_ENDINGS) + r")\z") | h.rlike("|".join(NEEDS_NONE)) | T.matches(h, r"^\d+\z") | F.arrays_overlap(tokens, F.array(*map(F.lit, NEEDS_NONE_TOKENS)))


def _headless(x: Context, rule_id: str, confidence: float = 0.5) -> DataFrame:
    return status(x.regions.where("coalesce(size(header_rows), 0) <= 0"), rule_id, passed=F.lit(True), confidence=confidence)


@rule("L3-04")
def units(x: Context) -> Result:
    first = x.inside.where("body and has_value").where(F.col("row") < F.col("body_start") + 30)
    number = F.col("vtype").isin("num", "bool") | T.matches(F.col("s"), r"^[\s\-ー−▲△]*[\d,]+\.?\d*\s*$")
    n = first.groupBy(*REGION_KEY, "col").agg((F.count_if(number) / F.count("*")).alias("share")).where("share >= 0.7").select(*REGION_KEY, "col")
    h = x.heads.join(n, [*REGION_KEY, "col"]).where(~names_unit(F.col("s")))
    clear = x.sure("infer_units", h.select(*REGION_KEY, "col", "s"))
    h = h if clear is None else h.join(clear.select(*REGION_KEY, "col"), [*REGION_KEY, "col"], "left_anti")
    return violations(h, "L3-04", "warning", F.col("s")), _headless(x, "L3-04")


#: Forms of dates, and headers of time columns.
ERA, JIS_ERA = r"(明治|大正|昭和|平成|令和|M|T|S|H|R)\s*(\d{1,2})\s*(年|\.|-|/)", r"^[MTSHR]\d{1,2}\.\d{1,2}\.\d{1,2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
KANJI_OR_SLASH = r"^(19|20)\d{2}(年\d{1,2}月(\d{1,2}日)?|/\d{1,2}(/\d{1,2})?|-\d{1,2}(-\d{1,2})?)$"
VAGUE, FISCAL, WESTERN = r"^\d{2}/\d{1,2}/\d{1,2}$|^(明治|大正|昭和|平成|令和)\d{1,2}$", r"^(19|20)\d{2}\s*年度", r"^(19|20)\d{2}\s*(年|/|-|\.)"
TIME_HEADER = r"(?i)(年|月|日|年度|時期|期間|期日|日付|日時|時点|年月|調査時点|対象期間|date|year|month|period)"


def time_form(v: Column) -> Column:
    """The form in which a time is written; null if it looks like none."""
    m = lambda p: T.matches(v, p)
    return (
        F.when(m(JIS_ERA), "jis_era").when(m(ISO), F.when(v.contains("T"), "iso_datetime").otherwise("iso_date")).when(m(ERA), "era").when(m(VAGUE), "vague").when(m(FISCAL), "fiscal_year")
        .when(m(KANJI_OR_SLASH), F.when(v.contains("年"), "kanji").when(v.contains("/"), "slash").otherwise("hyphen")).when(m(WESTERN), "western")
    )


@rule("L3-05")
def time_axis(x: Context) -> Result:
    eras = x.heads.where(T.matches(F.col("s"), "^" + ERA) & ~T.matches(F.col("s"), ISO) & ~T.matches(F.col("s"), JIS_ERA))
    cols = x.heads.where(F.col("vtext").rlike(TIME_HEADER)).select(*REGION_KEY, "col", F.col("row").alias("head"))
    c = x.body.join(cols, [*REGION_KEY, "col"]).withColumn("form", time_form(F.col("s"))).where("form is not null")
    mixed = c.where("form not in ('era', 'vague')").groupBy(*REGION_KEY, "col", "head").agg(F.array_sort(F.collect_set("form")).alias("forms")).where("size(forms) > 1")
    found = _union(
        violations(eras, "L3-05", "warning", F.lit("era in the header")),
        violations(c.where("form = 'era'"), "L3-05", "error", F.lit("era")),
        violations(c.where("form = 'vague'"), "L3-05", "warning", F.lit("vague date")),
        violations(mixed, "L3-05", "warning", F.array_join("forms", ","), "head"),
    )
    return found, _headless(x, "L3-05")


#: Headers of region columns.
REGION_HEADER = r"(?i)(都道府県|地域|地区|市区町村|自治体|所在地|住所|県|府|市|町|村|region|prefecture|city|address|地域コード|団体コード)"


@rule("L3-06")
def regions(x: Context) -> Result:
    names = F.broadcast((x.regions_dictionary if x.regions_dictionary is not None else dictionary(x.regions.sparkSession)).withColumnRenamed("name", "s"))  # a fixed list of some hundred names
    named = x.heads.where(F.col("s").rlike(REGION_HEADER)).select(*REGION_KEY, "col", F.col("s").alias("head"))
    known = x.body.join(names, "s", "left")
    first = known.where(F.col("row") < F.col("body_start") + 30).groupBy(*REGION_KEY, "col").agg((F.count("full") / F.count("*")).alias("share")).where("share >= 0.5")
    guessed = first.join(x.regions.where("size(header_rows) > 0").select(*REGION_KEY), REGION_KEY).join(named.select(*REGION_KEY).distinct(), REGION_KEY, "left_anti").join(x.heads.select(*REGION_KEY, "col", F.col("s").alias("head")), [*REGION_KEY, "col"], "left").select(*REGION_KEY, "col", "head")
    cols = named.unionByName(guessed)
    code = cols.groupBy(*REGION_KEY).agg(F.bool_or(F.coalesce(F.col("head").rlike("コード|(?i)code"), F.lit(False))).alias("code"))
    c = known.join(cols.select(*REGION_KEY, "col").distinct(), [*REGION_KEY, "col"]).join(code, REGION_KEY)
    one = c.where("full and not code").withColumn("k", F.row_number().over(Window.partitionBy(*REGION_KEY).orderBy("col", "row"))).where("k = 1")
    found = _union(
        violations(c.where("short"), "L3-06", "warning", F.lit("prefecture without its ending")),
        violations(c.where("not short and alias"), "L3-06", "warning", F.lit("municipality without its ending")),
        violations(one, "L3-06", "info", F.lit("no column of region codes")),
    )
    unclear = x.sure("header_clarity", x.heads.select(*REGION_KEY, "row", "col", "s").join(cols.select(*REGION_KEY, "col").distinct(), [*REGION_KEY, "col"]))
    found = found if unclear is None else found.unionByName(violations(unclear, "L3-06", "info", F.concat(F.lit("unclear name: "), F.col("s"))))
    none = x.regions.where("size(header_rows) > 0").join(cols.select(*REGION_KEY).distinct(), REGION_KEY, "left_anti")
    return found, _headless(x, "L3-06").unionByName(status(none, "L3-06", passed=F.lit(True), confidence=0.6))


#: Headers that are years, months, terms or era years.
YEAR, MONTH, TERM = r"^(19|20)\d{2}\s*(年|年度)?$", r"^(\d{1,2})\s*月$", r"^(第?\d+[期回]|(上|下|前|後)半期?|[1-4]Q|Q[1-4]|[上下]期)$"
ERA_YEAR = r"^(平成|令和|昭和)(\d{1,2}|元)\s*(年|年度)?$|^[RHS]\d{1,2}$"


def wide_kind(h: Column) -> Column:
    m = lambda p: T.matches(h, p)
    return F.when(m(YEAR), "1 year").when(m(MONTH), "2 month").when(m(TERM), "3 term").when(m(ERA_YEAR), "4 era")


def wide_headers(heads: DataFrame, by: list[str]) -> DataFrame:
    """The first kind of time that at least three headers are: by, kind, n, first and last column."""
    k = heads.withColumn("kind", wide_kind(F.col("s"))).where("kind is not null").groupBy(*by, "kind").agg(F.count("*").alias("n"), F.min("col").alias("c0"), F.max("col").alias("c1")).where("n >= 3")
    return k.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("kind"))).where("k = 1").drop("k")


def numbered_headers(heads: DataFrame, by: list[str]) -> DataFrame:
    """Names that at least four headers share but for a number behind them."""
    h = heads.withColumn("heads", F.count("*").over(Window.partitionBy(*by))).where("heads >= 5")
    h = h.withColumn("base", T.strip(F.regexp_extract("s", r"(?U)^(.+?)[\s_\-]?(\d+)\z", 1))).where("base <> ''").where(~T.matches(F.col("base"), r"^\d+\z"))
    return h.groupBy(*by, "base").agg(F.count("*").alias("n"), F.min("col").alias("c0"), F.max("col").alias("c1")).where("n >= 4")


@rule("L3-09")
def long_form(x: Context) -> Result:
    width = F.col("end_col") - F.col("start_col") + 1
    r = x.regions.where("size(header_rows) > 0").select(*REGION_KEY, "start_row", "end_row", "start_col", "end_col", F.try_element_at("header_rows", F.lit(-1)).alias("head"), width.alias("width"))
    broad = r.where("width >= 4")
    heads = x.heads.join(broad.select(*REGION_KEY, "head"), REGION_KEY)
    wide = wide_headers(heads, [*REGION_KEY, "head"])
    counted = numbered_headers(heads, [*REGION_KEY, "head"]).join(wide.select(*REGION_KEY), REGION_KEY, "left_anti")
    found = _union(
        violations(r.where("width > 100"), "L3-09", "error", F.lit("more than 100 columns"), "start_row", "start_col", "end_row", "end_col"),
        violations(wide, "L3-09", "warning", F.col("kind"), "head", "c0", "head", "c1"),
        violations(counted, "L3-09", "info", F.col("base"), "head", "c0", "head", "c1"),
    )
    names = heads.groupBy(*REGION_KEY, "head").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.array_sort(F.collect_list(F.struct("col", "s"))).alias("names"))  # of a table, its columns
    more = x.sure("wide_format", names.withColumn("names", F.transform("names", lambda n: n["s"])).join(wide.select(*REGION_KEY), REGION_KEY, "left_anti"))
    found = found if more is None else found.unionByName(violations(more, "L3-09", "warning", F.lit("one measure in several columns"), "head", "c0", "head", "c1"))
    return found, _headless(x, "L3-09").unionByName(status(r.where("width < 4"), "L3-09", passed=F.lit(True), confidence=0.8))


def evaluate(x: Context, rule_ids: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Violations, and a check per region and applicable rule.

    Where the context is cut, each rule's plan is run on its own and its result written,
    so that all rules together do not make one plan, and the checks do not find the
    violations again.

    A rule whose plan cannot be built counts as skipped; ``strict`` raises instead.
    """
    spark = x.regions.sparkSession
    found, states = [spark.createDataFrame([], VIOLATION)], [status(x.regions, "none").limit(0)]
    for i in rule_ids:
        try:
            v, s = REGISTRY[i](x)
        except Exception:
            if strict:
                raise
            v, s = None, status(x.regions, i, passed=F.lit(True), confidence=0.0)
        found += [cut(v) if x.cut else v] if v is not None else []
        states += [cut(s) if x.cut else s] if s is not None else []
    found, states = _union(*found), _union(*states)
    rules = spark.createDataFrame([(r.rule_id, r.level, r.target, r.severity, r.confidence, r.confidence_fail if r.confidence_fail is not None else r.confidence) for i in rule_ids if (r := RULE[i])] or [], "rule_id string, level int, target string, severity_of_rule string, sure_pass double, sure_fail double")
    kind = F.when(F.col("format") == "xlsx", "excel").otherwise("csv")
    grid = x.regions.select(*REGION_KEY).join(x.sheets.select(*KEY, "format"), KEY).join(F.broadcast(rules)).where((F.col("target") == "common") | (F.col("target") == kind)) if rule_ids else x.regions.select(*REGION_KEY).limit(0)
    counts = found.groupBy(*REGION_KEY, "rule_id").agg(F.count("*").alias("n_violations"))
    checks = grid.join(counts, [*REGION_KEY, "rule_id"], "left").join(states, [*REGION_KEY, "rule_id"], "left")
    n = F.coalesce("n_violations", F.lit(0))
    passed = F.coalesce("passed", n == 0)
    checks = checks.select(
        *REGION_KEY, "rule_id", "level", passed.alias("passed"), F.coalesce("severity", "severity_of_rule", F.lit("major")).alias("severity"),
        F.coalesce("confidence", F.when(passed, F.col("sure_pass")).otherwise(F.col("sure_fail"))).alias("confidence"), n.cast("long").alias("n_violations"),
    )
    return found, checks
