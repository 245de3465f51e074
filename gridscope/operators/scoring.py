"""Level scores: one formula at the grain of tables, sheets and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscope.model import DEDUCTIONS, FORCED_ZERO

GRAINS = {"table": ["file_id", "sheet_ix", "region_ix"], "sheet": ["file_id", "sheet_ix"], "file": ["file_id"]}


def marked(checks: DataFrame, deductions: dict | None = None, forced_zero: frozenset | None = None) -> DataFrame:
    """Checks that count, with the points that each takes and whether it forces zero."""
    points = DEDUCTIONS if deductions is None else deductions
    zero = FORCED_ZERO if forced_zero is None else forced_zero
    active = checks.where("confidence > 0").withColumn("severity", F.coalesce("severity", F.lit("major")))
    table = F.create_map(*[F.lit(x) for (level, s), p in points.items() for x in (f"{level}/{s}", p)])
    failed = ~F.col("passed")
    forced = failed & F.col("severity").isin(list(zero)) if zero else F.lit(False)
    key = F.concat_ws("/", F.col("level").cast("string"), "severity")
    taken = F.when(failed & ~forced, F.coalesce(F.try_element_at(table, key), F.raise_error(F.concat(F.lit("no deduction for "), key)).cast("int"))).otherwise(0)
    return active.withColumn("forced", forced).withColumn("taken", taken)


def scores(checks: DataFrame, deductions: dict | None = None, forced_zero: frozenset | None = None) -> DataFrame:
    """Scores of all three grains in one pass: grain, keys, level, score, n_checks, n_failed, failed and forced rules."""
    m = marked(checks, deductions, forced_zero)
    keys = ["file_id", "level", "sheet_ix", "region_ix"]
    out = m.groupingSets([keys, keys[:3], keys[:2]], *keys).agg(
        F.grouping_id(*keys).alias("grouping"), F.bool_or("forced").alias("forced_zero"), F.sum("taken").alias("taken"), F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("rule_id")))).alias("failed_rules"), F.array_sort(F.collect_list(F.when(F.col("forced"), F.col("rule_id")))).alias("forced_rules"),
    )
    grain = F.when(F.col("grouping") == 0, "table").when(F.col("grouping") == 1, "sheet").otherwise("file")
    score = F.when(F.col("forced_zero"), 0).otherwise(F.greatest(F.lit(0), 100 - F.col("taken")))
    return out.select(grain.alias("grain"), "file_id", "sheet_ix", "region_ix", "level", score.alias("score"), "forced_zero", "n_checks", "n_failed", "failed_rules", "forced_rules")


def violation_groups(violations: DataFrame, by: list[str], samples: int = 3) -> DataFrame:
    """Counts by severity with the first places, most frequent first; only these places are gathered."""
    place = ["start_row", "start_col", "end_row", "end_col"]
    ranked = violations.withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "severity").orderBy(*place)))
    g = ranked.groupBy(*by, "severity").agg(F.max("__rank").cast("long").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__rank") <= samples, F.struct(*place)))).alias("samples"))
    return g.orderBy(*by, F.desc("n"), "severity")
