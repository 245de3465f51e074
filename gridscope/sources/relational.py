"""Any DataFrame as the cells of a sheet: the header is row 1, records follow in key order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscope.operators.lineage import cut

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def row_numbers(df: DataFrame, keys: list[str] | None) -> DataFrame:
    """df with ``row`` from 2 on, in key order or as it is read, without one task for all rows.

    Rows are dealt in ranges of the keys and counted within each part; a part starts
    after the sizes of the parts before it. The parts are written, so that sizes and
    rows are of the same parts.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    placed = cut(placed.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row a part
    row = F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("__before") + 2
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("row", row.cast("int")).drop("__id", "__part", "__before")


def cells(df: DataFrame, file_id: str, keys: list[str] | None = None, sheet_ix: int = 0) -> DataFrame:
    """(file_id, sheet_ix, row, col, vtype, vtext, vnum) of a DataFrame; nested columns become JSON text."""
    columns = df.columns
    placed = row_numbers(df, keys)

    def one(c: str, i: int):
        t = dict(df.dtypes)[c]
        kind = "num" if t in _NUMBERS or t.startswith("decimal") else "bool" if t == "boolean" else "date" if t in ("date", "timestamp", "timestamp_ntz") else "str"
        text = F.col(c).cast("string") if not t.startswith(("array", "map", "struct")) else F.to_json(c)
        number = F.col(c).cast("double") if kind in ("num", "bool") else F.lit(None).cast("double")
        return F.struct(F.lit(i).alias("col"), F.when(text.isNull() | (text == ""), None).otherwise(kind).alias("vtype"), F.when(text != "", text).alias("vtext"), number.alias("vnum"))

    body = placed.select("row", F.explode(F.array(*[one(c, i) for i, c in enumerate(columns, 1)])).alias("x")).select("row", "x.*")
    spark = df.sparkSession
    head = spark.createDataFrame([(1, i, "str", c, None) for i, c in enumerate(columns, 1)], "row int, col int, vtype string, vtext string, vnum double")
    return head.unionByName(body).select(F.lit(file_id).alias("file_id"), F.lit(sheet_ix).alias("sheet_ix"), "row", "col", "vtype", "vtext", "vnum")
