"""Tables with a known layout as regions: header in row 1, body below; no layout inference is needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.functions.text import value_kind
from gridscope.operators import rules
from gridscope.operators.bands import column_kinds
from gridscope.operators.lineage import cut
from gridscope.sources.relational import cells

_ABSENT = {"formula": "string", "m_row": "int", "m_col": "int", "font": "string", "bg": "string"}


def context(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]]) -> rules.Context:
    """A rule context over DataFrames, given by name with the columns that order them."""
    frames = [cells(df, name, keys) for name, (df, keys) in tables.items()]
    all_cells = reduce(DataFrame.unionByName, frames)
    for c, t in _ABSENT.items():
        all_cells = all_cells.withColumn(c, F.lit(None).cast(t))
    all_cells = all_cells.withColumns({c: F.lit(False) for c in ("merged", "bold", "italic")})
    all_cells = cut(all_cells)  # read by every rule
    sizes = all_cells.groupBy("file_id", "sheet_ix").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))
    kinds = column_kinds(all_cells.where("row > 1"), ["file_id", "sheet_ix", "col"], value_kind(F.col("vtype"), F.col("vtext"))).groupBy("file_id", "sheet_ix").agg(F.map_from_entries(F.collect_list(F.struct("col", "ctype"))).alias("types"))
    names = all_cells.where("row = 1").groupBy("file_id", "sheet_ix").agg(F.map_from_entries(F.collect_list(F.struct("col", "vtext"))).alias("headers"))
    stubs = F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda c: (c < F.col("max_col")) & (F.try_element_at("types", c) == "text"))
    regions = sizes.join(kinds, ["file_id", "sheet_ix"], "left").join(names, ["file_id", "sheet_ix"]).select(
        "file_id", "sheet_ix", F.lit(0).alias("region_ix"), F.lit(1).alias("start_row"), F.lit(1).alias("start_col"), F.col("max_row").alias("end_row"), F.col("max_col").alias("end_col"), F.array(F.lit(1)).alias("header_rows"), F.lit(2).alias("body_start"), F.col("max_row").alias("body_end"),
        "headers", F.array().cast("array<int>").alias("merged_headers"), "types", stubs.alias("stub_cols"), F.lit(1.0).alias("confidence"), F.lit(False).alias("abstain"),
    )
    regions = cut(regions)
    empty = lambda schema: spark.createDataFrame([], schema)
    sheets = sizes.select("file_id", "sheet_ix", F.col("file_id").alias("sheet"), F.col("file_id").alias("name"), F.lit("csv").alias("format"), F.lit("utf-8").alias("encoding"), "max_row", "max_col", F.lit(False).alias("hidden"), F.array().cast("array<int>").alias("hidden_rows"), F.array().cast("array<int>").alias("hidden_cols"), F.lit(False).alias("formulas_loaded"), F.lit(False).alias("objects_loaded"))
    key = "file_id string, sheet_ix int, "
    return rules.Context(
        all_cells, sheets, empty(key + "start_row int, start_col int, end_row int, end_col int"), empty(key + "kind string, row int, col int, detail string"),
        empty(key + "records long, counts map<string,long>, widths map<string,long>, samples array<struct<type:string,severity:string,row:int,line:int,preview:string>>, truncated boolean, abort_reason string, confidence double"),
        regions, empty(key + "row int, col int, text string, kind string"), cut=True,
    )
