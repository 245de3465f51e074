"""Reports: flat rows for CSV, one JSON document per file, cells with their violations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridscope.functions.text import a1_range
from gridscope.model import RULE, RULES, SAMPLES, SUMMARISE_ABOVE
from gridscope.plans.analyze import Analysis

KEY = ["file_id", "sheet_ix", "region_ix"]


def _titles(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(r.rule_id, r.title) for r in RULES], "rule_id string, title string"))


def summaries(violations: DataFrame, by: list[str]) -> DataFrame:
    """Places, reasons and severities of each check as text; many violations as the first places and counts.

    Only the first ``SUMMARISE_ABOVE`` of a check are gathered; the others are counted.
    """
    place = a1_range(F.col("start_row"), F.col("start_col"), F.col("end_row"), F.col("end_col"))
    v = violations.withColumn("place", place)
    v = v.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy("start_row", "start_col", "place", "detail", "severity")))
    few = F.when(F.col("__rank") <= SUMMARISE_ABOVE, F.struct("__rank", "place", "detail", "severity"))
    g = v.groupBy(*by).agg(F.max("__rank").cast("long").alias("n"), F.array_sort(F.collect_list(few)).alias("all"), *[F.count_if(F.col("severity") == c).alias(c) for c in ("error", "warning", "info")])
    many = F.col("n") > SUMMARISE_ABOVE
    text = lambda f: F.array_join(F.transform(F.when(many, F.slice("all", 1, SAMPLES)).otherwise(F.col("all")), lambda x: x[f]), "; ")
    counts = F.array_join(F.array_compact(F.array(*[F.when(F.col(s) > 0, F.concat(F.lit(f"{s}: "), F.col(s).cast("string"))) for s in ("error", "warning", "info")])), "; ")
    return g.select(*by, "n", F.when(many, F.concat(text("place"), F.lit(" and more, "), F.col("n").cast("string"), F.lit(" in all"))).otherwise(text("place")).alias("places"), F.when(many, counts).otherwise(text("detail")).alias("details"), F.when(many, counts).otherwise(text("severity")).alias("severities"))


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, original) from a JSON file, an object or a list of objects, that gives rules their original texts."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # a file of some thirty texts
    given = json.loads(text)
    rows = list(given.items()) if isinstance(given, dict) else [(x.get("rule_id") or x.get("id"), x.get("description") or x.get("text")) for x in given]
    return spark.createDataFrame([(str(i), str(t)) for i, t in rows if i], "rule_id string, original string")


def report_rows(a: Analysis, original: DataFrame | None = None) -> DataFrame:
    """A row per file, sheet, table and rule; with their original texts (rule_id, original) if these are given."""
    head = F.when(F.size("header_rows") > 0, a1_range(F.array_min("header_rows"), F.col("start_col"), F.array_max("header_rows"), F.col("end_col")))
    r = a.regions.select(*KEY, a1_range(F.col("start_row"), F.col("start_col"), F.col("end_row"), F.col("end_col")).alias("table_range"), head.alias("header_range"), (F.col("end_col") - F.col("start_col") + 1).alias("columns"))
    s = a.workbooks.sheets.select("file_id", "sheet_ix", "name", "sheet")
    out = a.checks.join(r, KEY).join(s, ["file_id", "sheet_ix"]).join(summaries(a.violations, [*KEY, "rule_id"]), [*KEY, "rule_id"], "left").join(_titles(a.checks.sparkSession), "rule_id")
    if original is not None:
        out = out.join(F.broadcast(original), "rule_id", "left")  # a text for each rule
    return out.select(
        F.col("name").alias("file"), "sheet", "table_range", "header_range", "columns", "rule_id", F.col("title").alias("rule"), F.when(F.col("passed"), "pass").otherwise("fail").alias("verdict"), (F.col("confidence") == 0).alias("skipped"),
        "severity", F.format_number("confidence", 2).alias("confidence"), "n_violations", "places", "details", "severities", *(["original"] if original is not None else []),
    ).orderBy("file", "sheet", "table_range", "rule_id")


def json_documents(a: Analysis) -> DataFrame:
    """(file_id, json): one report per file; keys of empty parts are left out, unscored levels are null."""
    checks = a.checks.join(a.violations.groupBy(*KEY, "rule_id").agg(F.array_sort(F.collect_list(F.struct("start_row", "start_col", "end_row", "end_col", "severity", "detail"))).alias("found")), [*KEY, "rule_id"], "left")
    checks = checks.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rule_id", "passed", "severity", "confidence", "found"))).alias("checks"))
    tables = a.regions.join(checks, KEY, "left").groupBy("file_id", "sheet_ix").agg(F.array_sort(F.collect_list(F.struct("region_ix", "start_row", "start_col", "end_row", "end_col", "header_rows", "confidence", F.to_json("headers").alias("headers"), F.to_json("types").alias("types"), "checks"))).alias("tables"))
    others = a.others.groupBy("file_id", "sheet_ix").agg(F.array_sort(F.collect_list(F.struct("row", "col", "text", "kind"))).alias("others"))
    sheets = a.workbooks.sheets.join(tables, ["file_id", "sheet_ix"], "left").join(others, ["file_id", "sheet_ix"], "left")
    files = sheets.groupBy("file_id").agg(F.first("name").alias("name"), F.first("size").alias("size"), F.first("format").alias("format"), F.array_sort(F.collect_list(F.struct("sheet_ix", "sheet", "max_row", "max_col", "hidden", "tables", "others"))).alias("sheets"))
    scores = a.scores.where("grain = 'file'").groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("level").cast("string"), "score")))).alias("scores"))
    packed = files.join(scores, "file_id", "left").select("file_id", F.to_json(F.struct("name", "size", "format", "scores", "sheets")).alias("raw"))
    return packed.select("file_id", _document("raw").alias("json"))


def _letters(c: int) -> str:
    out = ""
    while c:
        c, r = divmod(c - 1, 26)
        out = chr(65 + r) + out
    return out


def _range(x: dict) -> str:
    a, b = f"{_letters(x['start_col'])}{x['start_row']}", f"{_letters(x['end_col'])}{x['end_row']}"
    return a if a == b else f"{a}:{b}"


def document(raw: dict) -> dict:
    def check(c: dict) -> dict:
        found = c.get("found") or []
        out = {"ruleId": c["rule_id"], "rule": RULE[c["rule_id"]].title, "passed": c["passed"], "skipped": c["confidence"] == 0, "severity": c["severity"], "confidence": c["confidence"], "violations": [{"range": _range(v), "severity": v["severity"], "detail": v.get("detail")} for v in found]}
        if len(found) > SUMMARISE_ABOVE:
            groups: dict[str, list] = {}
            for v in found:
                groups.setdefault(v["severity"], []).append(_range(v))
            out["violationGroups"] = {"total": len(found), "groups": [{"severity": s, "count": len(r), "samples": r[:SAMPLES]} for s, r in sorted(groups.items(), key=lambda g: -len(g[1]))]}
        return out

    def table(t: dict) -> dict:
        heads = t.get("header_rows") or []
        out = {"range": _range(t), "confidence": t["confidence"], "headerRows": heads, "headerRange": _range(t | {"start_row": min(heads), "end_row": max(heads)}) if heads else None, "columnCount": t["end_col"] - t["start_col"] + 1, "checks": [check(c) for c in t.get("checks") or []]}
        for key in ("headers", "types"):
            if (value := json.loads(t.get(key) or "{}")):
                out[key] = value
        return out

    def sheet(s: dict) -> dict:
        out = {"sheet": s["sheet"], "maxRow": s["max_row"], "maxCol": s["max_col"], "hidden": s["hidden"], "tables": [table(t) for t in s.get("tables") or []]}
        if s.get("others"):
            out["others"] = s["others"]
        return out

    scores = raw.get("scores") or {}
    return {"file": raw["name"], "size": raw["size"], "format": raw["format"], "sheetCount": len(raw["sheets"]), "levelScores": {k: scores.get(k) for k in "123"}, "sheets": [sheet(s) for s in raw["sheets"]]}


@F.pandas_udf(StringType())
def _document(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: json.dumps(document(json.loads(x)), ensure_ascii=False, indent=2))


def cell_overlay(a: Analysis) -> DataFrame:
    """Cells of a table that violations touch, with the worst severity."""
    rank = F.create_map(*[F.lit(x) for p in (("error", 3), ("warning", 2), ("info", 1)) for x in p])
    v = a.violations.select(*KEY, "severity", F.explode(F.sequence("start_row", "end_row")).alias("row"), "start_col", "end_col").select(*KEY, "severity", "row", F.explode(F.sequence("start_col", "end_col")).alias("col"))
    return v.groupBy(*KEY, "row", "col").agg(F.max_by("severity", rank[F.col("severity")]).alias("severity"))


def _roles(a: Analysis) -> DataFrame:
    """Cells of tables with their place in the layout: header, label, body or blank."""
    r = a.regions.select(*KEY, "start_row", "end_row", "start_col", "end_col", "header_rows", "body_start", "body_end", "stub_cols")
    c = r.select(*KEY, "header_rows", "body_start", "body_end", "stub_cols", "start_col", "end_col", F.explode(F.sequence("start_row", "end_row")).alias("row")).withColumn("col", F.explode(F.sequence("start_col", "end_col")))
    role = F.when(F.array_contains("header_rows", F.col("row")), "header").when(F.col("row").between(F.col("body_start"), F.col("body_end")), F.when(F.array_contains("stub_cols", F.col("col")), "label").otherwise("body")).otherwise("blank")
    return c.select(*KEY, "row", "col", role.alias("role"))


def grid(a: Analysis) -> DataFrame:
    """Each cell of a table: its role, and the worst severity of the violations that touch it."""
    return _roles(a).join(cell_overlay(a), [*KEY, "row", "col"], "left")


def bulk_rows(a: Analysis, batch_ids: DataFrame | None = None) -> DataFrame:
    """Rows of all files, and a row "(bulk)" for each check of a batch, with all its violations."""
    checks, _, _ = a.batch(batch_ids)
    bulk_ = checks.select(F.lit("(bulk)").alias("file"), F.col("batch_id").alias("sheet"), F.lit("L3-07").alias("rule_id"), F.lit(RULE["L3-07"].title).alias("rule"), F.when(F.col("passed"), "pass").otherwise("fail").alias("verdict"), (F.col("confidence") == 0).alias("skipped"), F.lit(RULE["L3-07"].severity).alias("severity"), F.format_number("confidence", 2).alias("confidence"), F.size("violations").cast("long").alias("n_violations"), F.array_join(F.transform("violations", lambda v: v["kind"]), "; ").alias("details"))
    return report_rows(a).unionByName(bulk_, allowMissingColumns=True)


def bulk_documents(a: Analysis, batch_ids: DataFrame | None = None) -> DataFrame:
    """(batch_id, json): totals of a batch, its checks, and the mean and the report of each file.

    A batch's reports are one document, so a batch is as large as one document may be.
    """
    checks, means, total = a.batch(batch_ids)
    files = means.join(json_documents(a), "file_id", "left").groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("file_id", "mean_score", "json"))).alias("files"))
    found = checks.groupBy("batch_id").agg(F.collect_list(F.struct("passed", "confidence", F.transform("violations", lambda v: v["kind"]).alias("violations"))).alias("checks"))
    packed = total.join(files, "batch_id").join(found, "batch_id", "left").select("batch_id", F.to_json(F.struct(F.col("batch_id").cast("string").alias("batch"), "total_score", "checks", "files")).alias("raw"))
    return packed.select("batch_id", _bulk_document("raw").alias("json"))


@F.pandas_udf(StringType())
def _bulk_document(raw: pd.Series) -> pd.Series:
    def one(x: dict) -> dict:
        files = [{"file": f["file_id"], "meanScore": f.get("mean_score"), "report": json.loads(f["json"]) if f.get("json") else None} for f in x.get("files") or []]
        return {"batch": x["batch"], "totalScore": x.get("total_score"), "fileCount": len(files), "checks": x.get("checks") or [], "files": files}

    return raw.map(lambda x: json.dumps(one(json.loads(x)), ensure_ascii=False, indent=2))


def write_json(a: Analysis, path: str) -> None:
    json_documents(a).select("json").write.text(path)


def write_csv(a: Analysis, path: str, original: DataFrame | None = None) -> None:
    report_rows(a, original).write.option("header", True).csv(path)


def write_bulk_json(a: Analysis, path: str, batch_ids: DataFrame | None = None) -> None:
    bulk_documents(a, batch_ids).select("json").write.text(path)


def write_bulk_csv(a: Analysis, path: str, batch_ids: DataFrame | None = None) -> None:
    bulk_rows(a, batch_ids).write.option("header", True).csv(path)
