import json

import pytest
from pyspark.sql import functions as F

from gridscope import semantic
from gridscope.plans import report
from gridscope.plans.analyze import Options, analyze_bytes


def models():
    """Two models that tasks can run: one fails, one is sure of everything that mentions one of these texts."""

    def broken(prompt: str) -> str:
        raise OSError("no connection")

    def answers(prompt: str) -> str:
        sure = any(t in prompt for t in ("在庫", "特記", "ない"))
        return '```json\n{"confidence": %s}\n```' % (0.9 if sure else 0.1)

    return [broken, answers]


TABLE = "品目,在庫,特記,重さ（kg）,価格,回答\n" + "".join(f"品{i},{['10', '0', '', '50', '0'][i % 5]},{1000 + i},{i}.25,{2000 + i},{'はい' if i % 2 else 'いいえ'}\n" for i in range(30)) + "品z,70,1131,1.25,2131,ない\n"


def test_answers_and_fallback():
    assert semantic.unfenced('Sure:\n```json\n{"confidence": 1}\n```') == '{"confidence": 1}'
    broken, answers = models()
    a = semantic.asked([broken, answers], "q", {"s": "在庫"})
    assert (a.confidence, a.calls, a.failures) == (0.9, 3, 2) and a.characters > 0
    assert semantic.asked([broken], "q", {}).confidence == 0
    assert semantic.asked([lambda p: "no json"], "q", {}).confidence == 0


@pytest.fixture(scope="module")
def analyses(spark):
    files = [("a.csv", TABLE.encode()), ("b.csv", TABLE.replace("特記,重さ（kg）", "重さ（kg）,特記").encode())]
    options = Options(mode="thorough", strict=True)
    return analyze_bytes(spark, files, options), analyze_bytes(spark, files[:1], options, semantic.PromptProvider(models()))


def test_rules_with_a_model(analyses):
    without, with_ = ({(r.rule_id): (r.passed, r.confidence, r.n_violations) for r in a.checks.where("file_id = 'a.csv'").collect()} for a in analyses)
    assert without["L1-09"] == (True, 0.0, 0) and with_["L1-09"] == (False, 0.8, 1)
    assert without["L3-04"][2] == 2 and with_["L3-04"][2] == 0
    assert without["L2-04"][2] == 0 and with_["L2-04"][2] == 1


def test_bulk_reports(analyses, tmp_path):
    a = analyses[0]
    (row,) = report.bulk_documents(a).collect()
    d = json.loads(row.json)
    assert d["fileCount"] == 2 and d["checks"][0]["violations"] == ["order differs"] and {f["report"]["file"] for f in d["files"]} == {"a.csv", "b.csv"}
    rows = report.bulk_rows(a).collect()
    assert [(r.sheet, r.details, r.verdict) for r in rows if r.file == "(bulk)"] == [("all", "order differs", "fail")]
    path = tmp_path / "texts.json"
    path.write_text(json.dumps([{"rule_id": "L1-01", "description": "text of the rule"}]))
    spark = a.checks.sparkSession
    got = report.report_rows(a, report.descriptions(spark, str(path))).where("rule_id = 'L1-01'").select("original").distinct().collect()
    assert [r.original for r in got] == ["text of the rule"]


def test_cell_roles(analyses):
    roles = analyses[0].regions.sparkSession and report.grid(analyses[0]).where("file_id = 'a.csv'")
    n = {r.role: r["count"] for r in roles.groupBy("role").count().collect()}
    assert n["header"] == 6 and n["label"] == 31 and n["body"] == 155
    assert roles.where(F.col("severity").isNotNull()).count() > 0
