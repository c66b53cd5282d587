"""Sessions of events: the same grouping over tables and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, start, end, n of runs of events no more than `gap` apart; the end is the last event's time plus the gap.

    On a stream, `late` is how late events may come; a session is emitted once it can't grow.
    """
    if late:
        events = events.withWatermark("ts", late)
    d = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return d.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def event_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of events as they come; timestamps without zone are read as UTC instants, as watermarks need."""
    d = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def write_sessions(stream: DataFrame, gap: str, late: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished sessions as Parquet; what has been read is kept in `checkpoint`, so a restart loses and repeats nothing."""
    q = sessions(stream, gap, late).writeStream.format("parquet").outputMode("append")
    return q.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
