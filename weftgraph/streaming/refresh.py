"""Incremental refresh, an extension: streamed commits and snapshots keep stored tables current, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated_stream(rows: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """A stream without rows that repeat their keys; state older than the watermark is dropped."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counted_windows(rows: DataFrame, at: str, by: list[str], length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each key in each window of time, late ones up to the watermark counted."""
    return rows.withWatermark(at, late).groupBy(F.window(at, length), *by).agg(F.count("*").alias("n"))


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream whose keys the Parquet table at target doesn't have; a repeated micro-batch adds nothing."""
    schema = stream.schema

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(keys)
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(path):
            known = batch.sparkSession.read.schema(schema).parquet(target).select(*keys)
            batch = batch.join(known, keys, "left_anti")
        batch.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
