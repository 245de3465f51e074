"""The whole analysis: files -> records -> regions -> checks and violations -> scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.model import MODES, RULES
from gridscope.operators import bulk, rules, scoring
from gridscope.operators.layout import lay_out
from gridscope.operators.lineage import cut
from gridscope.semantic import NoProvider
from gridscope.sources.files import Workbooks, parse_files, read_records


@dataclass(frozen=True)
class Options:
    """mode picks levels unless levels are given; custom_rules is an allow-list; strict raises plan errors."""

    mode: str = "standard"
    levels: tuple[int, ...] | None = None
    custom_rules: tuple[str, ...] | None = None
    confidence_threshold: float = 0.7
    strict: bool = False

    def rule_ids(self) -> list[str]:
        levels = self.levels or MODES[self.mode]
        return [r.rule_id for r in RULES if r.level in levels and (self.custom_rules is None or r.rule_id in self.custom_rules)]


@dataclass
class Analysis:
    workbooks: Workbooks
    regions: DataFrame
    others: DataFrame
    violations: DataFrame
    checks: DataFrame
    scores: DataFrame

    def batch(self, batch_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Over batches (file_id, batch_id), or one batch of all files: checks, file means and total scores."""
        files = batch_ids if batch_ids is not None else self.workbooks.sheets.select("file_id").distinct().withColumn("batch_id", F.lit("all"))
        headers = bulk.top_headers(self.regions).join(files, "file_id")
        checks = bulk.consistency(files, headers, ["batch_id"])
        means = bulk.file_means(self.scores.where("grain = 'file'")).join(files, "file_id", "right")
        return checks, means, bulk.total(means, checks, ["batch_id"])


def analyze(workbooks: Workbooks, options: Options = Options(), regions_dictionary: DataFrame | None = None, semantic=None) -> Analysis:
    layout = cut(lay_out(workbooks.records, options.confidence_threshold))
    regions = layout.where("region_ix is not null").drop("others")
    others = layout.where("region_ix is null").select("file_id", "sheet_ix", F.explode("others").alias("o")).select("file_id", "sheet_ix", F.col("o.row").alias("row"), F.col("o.col").alias("col"), F.col("o.text").alias("text"), F.col("o.kind").alias("kind"))
    context = rules.Context(workbooks.cells, workbooks.sheets, workbooks.merges, workbooks.references, workbooks.diagnoses, regions, others, regions_dictionary, cut=True, semantic=semantic or NoProvider())
    violations, checks = rules.evaluate(context, options.rule_ids(), options.strict)
    checks = cut(checks)
    return Analysis(workbooks, regions, others, violations, checks, scoring.scores(checks))


def analyze_files(spark: SparkSession, path: str | list[str], options: Options = Options(), semantic=None) -> Analysis:
    return analyze(Workbooks(cut(read_records(spark, path))), options, semantic=semantic)


def analyze_bytes(spark: SparkSession, files: list[tuple[str, bytes]], options: Options = Options(), semantic=None) -> Analysis:
    """Files given as (name, bytes)."""
    given = spark.createDataFrame([(n, bytearray(b)) for n, b in files], "path string, content binary")
    return analyze(Workbooks(cut(parse_files(given))), options, semantic=semantic)
