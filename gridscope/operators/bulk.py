"""Rules over a batch of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least similarity of header sets, and most spread of column counts.
SIMILARITY, SPREAD, FILES_SHARE, CHECKS_SHARE = 0.8, 1.5, 0.7, 0.3


def top_headers(regions: DataFrame) -> DataFrame:
    """(file_id, headers): labels of the first table that has any; sheets in order, tables by confidence."""
    labels = F.filter(F.map_values("headers"), lambda h: h != "")
    r = regions.withColumn("labels", labels).where("size(labels) > 0")
    w = Window.partitionBy("file_id").orderBy("sheet_ix", "region_ix")
    return r.withColumn("k", F.row_number().over(w)).where("k = 1").select("file_id", F.col("labels").alias("headers"))


def pairs(headers: DataFrame, by: list[str]) -> DataFrame:
    """Each two files of a batch that differ in their headers: Jaccard similarity, and whether common headers change order.

    Files with equal headers are one; a batch of many alike files has few kinds.
    """
    kinds = headers.groupBy(*by, "headers").agg(F.min("file_id").alias("file_id"))
    a, b = kinds.select(*by, F.col("file_id").alias("a"), F.col("headers").alias("x")), kinds.select(*by, F.col("file_id").alias("b"), F.col("headers").alias("y"))
    met = (a.join(b, by) if by else a.crossJoin(b)).where("a < b")
    common = F.array_intersect("x", "y")
    order = lambda c: F.filter(c, lambda h: F.array_contains(F.col("common"), h))
    met = met.withColumn("common", common).withColumn("jaccard", F.size("common") / F.size(F.array_union("x", "y")))
    return met.withColumn("reordered", (F.size("common") >= 2) & (order(F.array_distinct("x")) != order(F.array_distinct("y"))))


def consistency(files: DataFrame, headers: DataFrame, by: list[str]) -> DataFrame:
    """The format check of each batch: batch keys, passed, confidence, and its violations as an array of (kind, severity)."""
    met = files.join(headers, [*by, "file_id"], "left")
    n = met.groupBy(*by).agg(F.count("*").alias("files"), F.count("headers").alias("usable"), F.stddev_pop(F.size("headers")).alias("spread"))
    p = pairs(headers, by).groupBy(*by).agg(F.min("jaccard").alias("jaccard"), F.bool_or("reordered").alias("reordered"))
    n = n.join(p, by, "left") if by else n.crossJoin(p)
    enough = F.col("usable") >= 2
    tests: list[tuple[str, str, Column]] = [
        ("headers missing", "warning", F.col("usable") < F.col("files")),
        ("headers differ", "warning", enough & (F.col("jaccard") < SIMILARITY)),
        ("column counts differ", "warning", enough & (F.col("spread") > SPREAD)),
        ("order differs", "info", enough & F.col("reordered")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, t in tests]))
    out = n.where("files >= 2").withColumn("violations", found)
    return out.select(*by, "files", "usable", (F.size("violations") == 0).alias("passed"), F.when(enough, 0.8).otherwise(0.5).alias("confidence"), "violations")


def file_means(level_scores: DataFrame) -> DataFrame:
    """Mean of a file's level scores, rounded half to even."""
    return level_scores.where("score is not null").groupBy("file_id").agg(F.bround(F.avg("score")).cast("int").alias("mean_score"))


def total(means: DataFrame, checks: DataFrame, by: list[str]) -> DataFrame:
    """A batch's score: the files' mean, and where there are active batch checks 30 percent their pass rate."""
    m = means.groupBy(*by).agg(F.avg("mean_score").alias("mean"))
    c = checks.where("confidence > 0").groupBy(*by).agg((F.count_if(F.col("passed")) / F.count("*")).alias("rate"))
    met = m.join(c, by, "left") if by else m.join(c)
    mean = F.coalesce("mean", F.lit(100.0))
    return met.select(*by, F.bround(F.when(F.col("rate").isNull(), mean).otherwise(mean * FILES_SHARE + F.col("rate") * 100 * CHECKS_SHARE)).cast("int").alias("total_score"))
