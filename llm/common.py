"""What the operators share: tables, code shipping and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.kernels import trim

_shipped: set[str] = set()


#: Bytes of a batch that tasks pass to Python: texts may be long, and a batch is held several times.
BATCH = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this subpackage to the executors once per application; batches to Python stay small."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # already runs from a shipped archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), "llm_operators.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"llm/{name}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, and no others: further columns may clash with ours."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors take nothing along."""
    path = f"{work_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()  # shuffle files of what is written now go when the driver collects garbage
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_llm_path", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Keys that are broadcast to filter a table before it is shuffled: so many at most.
KEYS_MOST = 1 << 20


def only(spark: SparkSession, df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """df without rows that a later join with the distinct keys would drop; of too many keys for a broadcast, df itself."""
    keys = written(spark, keys, "keys")
    return df.join(F.broadcast(keys), column, "left_semi") if keys.count() <= KEYS_MOST else df


def small(spark: SparkSession, df: DataFrame, entries) -> DataFrame:
    """df as a written table, for a broadcast join where it holds no more than ``KEYS_MOST`` entries in all."""
    df = written(spark, df, "small")
    n = df.agg(F.sum(entries)).first()[0] or 0
    return F.broadcast(df) if n <= KEYS_MOST else df


def crc_mod(column: str, m: int):
    """crc32 of the column as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(it: Iterator[pa.RecordBatch], most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of few rows, so that one batch of long texts stays small."""
    for batch in it:
        for i in range(0, batch.num_rows, most_rows):
            yield batch.slice(i, most_rows)
    trim()
