"""Streams of the pipeline's files as they arrive.

An extension of the batch operators: the same keys and rules over Structured Streaming, with watermarks so that
state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def loads_per_window(records: DataFrame, time: str = "loaded_at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, stage, records, files)``: records of each stage in tumbling windows; rows later than ``late`` are left out."""
    timed = records.withColumn("_ts", F.col(time).cast("timestamp")).where("_ts is not null").withWatermark("_ts", late)
    counts = timed.groupBy(F.window("_ts", window).alias("w"), "stage").agg(F.count("*").alias("records"), F.approx_count_distinct("file_name").alias("files"))
    return counts.select(F.col("w.start").alias("start"), "stage", "records", "files")


def first_arrivals(records: DataFrame, keys: list[str], time: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """Each key once, at its first row; a key's state is kept for ``late``."""
    timed = records.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_ts")


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to Parquet, exactly once; with ``available_now`` it ends when all files there are have been read."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
