"""Cutting long plans: a table in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where none is set, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = set_.get() if set_.isDefined() else "file://" + tempfile.mkdtemp(prefix="gridscope-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df as a written table, so that its plan is planned and run once and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/gridscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
