"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import drop, written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b); a component's id is its least node.

    Alternates large-star and small-star steps until edges no longer change.
    Each step sends a row per edge and a least neighbour per node, never a
    neighbourhood, so a hub costs no more than its edges; a step's result is a
    table in the shared folder.
    """
    now = written(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    nodes = now
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = total(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: edges point from the larger to the smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(spark, small, "edges")
        last, before = before, total(after)
        if now is not nodes:
            drop(spark, now)
        now = after
        if before == last:
            break
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    ids = nodes.select(F.col("u").alias("id")).unionByName(nodes.select(F.col("v").alias("id"))).distinct()
    return ids.join(stars, ids.id == stars.u, "left").select("id", F.coalesce("component", "id").alias("component"))
