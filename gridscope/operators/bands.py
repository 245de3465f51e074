"""Gap-and-islands and other counting operators over the cells of many sheets, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], index: str, gap: int = 1) -> DataFrame:
    """Runs of an integer column whose neighbours are at most ``gap`` apart: by, island, start, end, n."""
    w = Window.partitionBy(*by).orderBy(index)
    new = F.when(F.col(index) - F.lag(index).over(w) <= gap, 0).otherwise(1)
    marked = df.select(*by, index).distinct().withColumn("new", new)
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min(index).alias("start"), F.max(index).alias("end"), F.count("*").alias("n"))


def column_kinds(df: DataFrame, by: list[str], kind: Column) -> DataFrame:
    """Counts of value kinds and the vote on a column's type."""
    one = lambda k: F.count_if(kind == k)
    n = df.groupBy(*by).agg(one("numeric").alias("n_numeric"), one("date").alias("n_date"), one("text").alias("n_text"), one("empty").alias("n_empty"))
    filled = F.col("n_numeric") + F.col("n_date") + F.col("n_text")
    vote = F.when(filled == 0, "empty")
    for k in ("numeric", "date", "text"):
        vote = vote.when(F.col(f"n_{k}") >= filled * 0.8, k)
    return n.withColumn("ctype", vote.otherwise("mixed"))


def fill_rates(df: DataFrame, by: list[str], row: str, filled: Column, width: int) -> DataFrame:
    """Share of filled cells and of rows with data, and the confidence from both."""
    rows = df.groupBy(*by, row).agg(F.count_if(filled).alias("n"))
    least = max(min(width * 0.3, 2), 1)
    out = rows.groupBy(*by).agg((F.sum("n") / (F.count("*") * width)).alias("fill_rate"), (F.count_if(F.col("n") >= least) / F.count("*")).alias("row_rate"))
    return out.withColumn("confidence", F.bround(F.least(F.col("fill_rate") * 0.6 + F.col("row_rate") * 0.6, F.lit(1.0)), 3))


def nearest_above(tables: DataFrame, by: list[str], gap: int = 2) -> DataFrame:
    """As-of join: for each table without labels the closest one above with the same columns that has some."""
    t = tables.select(*by, "table_ix", "start_row", "end_row", "start_col", "end_col", "labelled")
    a = t.where("labelled").select(*by, F.col("table_ix").alias("above_ix"), F.col("end_row").alias("above_end"), "start_col", "end_col")
    met = t.where(~F.col("labelled")).join(a, [*by, "start_col", "end_col"]).where((F.col("start_row") - F.col("above_end") - 1).between(0, gap))
    w = Window.partitionBy(*by, "table_ix").orderBy(F.desc("above_end"), "above_ix")
    return met.withColumn("k", F.row_number().over(w)).where("k = 1").select(*by, "table_ix", "above_ix")


def missing_indices(spans: DataFrame, present: DataFrame, by: list[str], index: str, start: Column, end: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Indices between start and end of each span that ``present`` (by, index) lacks: an anti-join with the dense sequence."""
    dense = spans.select(*by, *keep, F.explode(F.sequence(start, end)).alias(index))
    return dense.join(present.select(*by, index), [*by, index], "left_anti")
