import json

import pytest

from gridscope.plans import report
from gridscope.plans.analyze import Options, analyze_bytes

GOOD = "都道府県,人口（人）,面積（㎢）\n" + "".join(f"県{i},{1000 + i},{20 + i}.5\n" for i in range(5))
BAD = "name,name,date\nx  y,100円,令和3年\nz,200,2020年1月\nw,300,2021-01-01\nv,400,2022-01-01\nu,500,2023-01-01\nt,600,2023-01-02\n"


@pytest.fixture(scope="module")
def analysis(spark):
    return analyze_bytes(spark, [("good.csv", GOOD.encode()), ("bad.csv", BAD.encode()), ("no.pdf", b"x")], Options(mode="thorough", strict=True))


def test_verdicts(analysis):
    failed = {(r.file_id, r.rule_id) for r in analysis.checks.where("not passed").collect()}
    assert {r for f, r in failed if f == "good.csv"} == set()
    assert {r for f, r in failed if f == "bad.csv"} == {"L1-06", "L2-01", "L2-03", "L3-05"}
    assert [r.name for r in analysis.workbooks.errors.collect()] == ["no.pdf"]


def test_scores(analysis):
    got = {(r.file_id, r.level): r.score for r in analysis.scores.where("grain = 'file'").collect()}
    assert got == {("good.csv", 1): 100, ("good.csv", 2): 100, ("good.csv", 3): 100, ("bad.csv", 1): 90, ("bad.csv", 2): 0, ("bad.csv", 3): 90}


def test_reports(analysis):
    documents = {d["file"]: d for d in (json.loads(r.json) for r in report.json_documents(analysis).collect())}
    assert documents["bad.csv"]["levelScores"] == {"1": 90, "2": 0, "3": 90}
    assert documents["good.csv"]["sheets"][0]["tables"][0]["range"] == "A1:C6"
    rows = {(r.file, r.rule_id): r for r in report.report_rows(analysis).collect()}
    assert rows["bad.csv", "L2-03"].places == "A1; B1" and rows["bad.csv", "L2-03"].verdict == "fail"
    assert {(r.row, r.col) for r in report.cell_overlay(analysis).where("file_id = 'bad.csv' and severity = 'error'").collect()} >= {(2, 2), (2, 3)}
