import pytest
from pyspark.sql import functions as F

from gridscope.functions import text as T
from gridscope.operators import bulk, rules, scoring


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_strip_is_unicode(spark):
    assert values(spark, ["　a\x1c", " \x85x\n", "", "\t "], T.strip) == ["　a\x1c".strip(), "x", "", ""]


def test_a1(spark):
    df = spark.createDataFrame([(1, 1), (2, 26), (3, 27), (4, 702), (5, 703), (6, 16384)], "r int, c int")
    assert [r[0] for r in df.select(T.a1(F.col("r"), F.col("c"))).collect()] == ["A1", "Z2", "AA3", "ZZ4", "AAA5", "XFD6"]


def test_boundaries(spark):
    texts = ["B3", "$A$1:c3", "AA10", "A:C", "2:5", "R1C2", "R1C2:R3C4", "row 3", "3行", "C列", "column C", "合計", "", None, "7"]
    got = [tuple(x) if x else None for x in values(spark, texts, T.boundaries)]
    assert got == [(3, 2, 3, 2), (1, 1, 3, 3), (10, 27, 10, 27), (None, 1, None, 3), (2, None, 5, None), (1, 2, 1, 2), (1, 2, 3, 4), (3, None, 3, None), (3, None, 3, None), (None, 3, None, 3), (None, 3, None, 3), None, None, None, None]


def test_whitespace(spark):
    texts = [" a", "a  b", "ア　x", "a\n", "1\n23456789", "1\n2345678", "漢　b"]
    assert values(spark, texts, rules.whitespace_issues) == [["edge"], ["run"], [], [], [], ["newline"], ["wide"]]


def test_one_datum(spark):
    texts = ["a\nb", "a\n ", "391445（355943）", "a、b、c", "a・b・c", "a・b", "1,234,567", "a,b", "1,2"]
    assert values(spark, texts, rules.several_data) == ["lines", None, "two measures", "enumeration", "enumeration by dots", None, None, "commas", "commas"]


def test_platform_characters(spark):
    assert values(spark, ["①", "Ⅲ", "Ⅰ-0", "㎡", "㈱", "Ａ", "カナ", "～", "a"], rules.platform_severity) == ["warning", "warning", "info", None, "warning", "info", None, "warning", None]


def test_impurity(spark):
    texts = ["3,000", "-5", "合計なし", "▲3,000", "200円", "5%", "5 (a)", "1①.所在地", "平成30年度"]
    assert values(spark, texts, lambda c: rules.impurity(c, F.lit(False))) == [None, None, None, "triangle", "unit", "percent", "note", "other", "other"]
    assert values(spark, ["5%"], lambda c: rules.impurity(c, F.lit(True))) == [None]


def test_time_forms(spark):
    texts = ["2020-01-02", "2020-01-02T03:04", "R8.05.13", "令和3年", "03/04/01", "令和3", "2020年度", "2020年1月", "2020/1/2", "2024-01-01 00:00:00", "x"]
    assert values(spark, texts, rules.time_form) == ["iso_date", "iso_datetime", "jis_era", "era", "vague", "vague", "fiscal_year", "kanji", "slash", "western", None]


def test_units(spark):
    assert values(spark, ["売上（円）", "人口", "件数", "item_id", "120", "x", "利益"], rules.names_unit) == [True, True, True, True, True, False, False]


def test_choice_variants(spark):
    df = spark.createDataFrame([("はい", "ﾊｲ"), ("とても満足", "とても満足※1"), ("あ", "い"), ("満足している", "満足してる")], "a string, b string")
    assert [r[0] for r in df.select(rules.same_choice("a", "b")).collect()] == [False, True, False, True]


CHECKS = "file_id string, sheet_ix int, region_ix int, rule_id string, level int, passed boolean, severity string, confidence double"


def test_scores(spark):
    rows = [("f", 0, 0, "a", 1, False, "critical", 1.0), ("f", 0, 1, "a", 1, False, "critical", 1.0), ("f", 0, 0, "b", 1, False, None, 0.9), ("f", 0, 0, "c", 1, False, "fatal", 0.0), ("f", 1, 0, "d", 2, False, "fatal", 1.0), ("f", 1, 0, "e", 3, False, "info", 1.0)]
    checks = spark.createDataFrame(rows, CHECKS)
    got = {(r.grain, r.sheet_ix, r.region_ix, r.level): r.score for r in scoring.scores(checks).collect()}
    assert got["file", None, None, 1] == 75 and got["table", 0, 0, 1] == 85 and got["file", None, None, 2] == 0 and got["file", None, None, 3] == 100
    assert {r.score for r in scoring.scores(checks, forced_zero=frozenset({"critical"}), deductions={(1, "major"): 5, (2, "fatal"): 7, (3, "info"): 0}).where("grain = 'file' and level = 2").collect()} == {93}
    with pytest.raises(Exception, match="no deduction"):
        scoring.scores(checks, deductions={}, forced_zero=frozenset()).collect()


def test_bulk(spark):
    def check(*headers):
        files = spark.createDataFrame([(f"f{i}", "b") for i in range(len(headers))], "file_id string, batch_id string")
        h = spark.createDataFrame([(f"f{i}", "b", h) for i, h in enumerate(headers) if h], "file_id string, batch_id string, headers array<string>")
        r = bulk.consistency(files, h, ["batch_id"]).collect()
        return (r[0].passed, r[0].confidence, [v.kind for v in r[0].violations]) if r else None

    same = ["a", "b", "c"]
    assert check(same, same, same) == (True, 0.8, [])
    assert check(same, ["a", "c", "b"]) == (False, 0.8, ["order differs"])
    assert check(same, ["x", "y", "z"]) == (False, 0.8, ["headers differ"])
    assert check(same, None) == (False, 0.5, ["headers missing"])
    assert check(same, same, list("abcdefg")) == (False, 0.8, ["headers differ", "column counts differ"])
    assert check(same) is None
