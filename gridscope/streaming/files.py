"""Files that arrive over time: files are independent, so each batch is analysed as files at rest are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridscope.plans.analyze import Options, analyze
from gridscope.sources.files import Workbooks, parse_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, sink, checkpoint: str, options: Options = Options(), once: bool = False) -> StreamingQuery:
    """Analyse new files of a folder; ``sink(analysis, batch_id)`` gets each batch's result."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)

    def batch(df: DataFrame, batch_id: int) -> None:
        if not df.isEmpty():
            records = parse_files(df).persist()
            try:
                sink(analyze(Workbooks(records), options), batch_id)
            finally:
                records.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
