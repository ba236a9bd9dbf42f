"""Resumable ingestion of a growing folder, event-time windows, late data, duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import todo


def ingest_new(
    spark: SparkSession, source: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], log: str, sink: str, checkpoint: str
) -> StreamingQuery:
    """Takes what is new in a stream once, and ends. Each batch leaves out keys that the log has from other batches, runs
    the rest, and logs those whose `status` is success; failed ones come again when they are offered again. Sink and log
    keep a folder for each batch of a checkpoint, which a repeated batch overwrites: a failure between the two writes
    neither loses nor doubles rows."""

    def batch(rows: DataFrame, number: int) -> None:
        own = f"{rows.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        done = spark.read.schema(f"{key} string, batch string").parquet(log).where(F.col("batch") != own)
        run(todo(rows, done, key)).where("status = 'success'").write.mode("overwrite").parquet(f"{sink}/batch={own}")
        stored = spark.read.parquet(f"{sink}/batch={own}")
        stored.select(F.col(key).cast("string")).distinct().write.mode("overwrite").parquet(f"{log}/batch={own}")

    spark.createDataFrame([], f"{key} string").write.mode("overwrite").parquet(f"{log}/batch=none")
    return source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) in tumbling or sliding windows; `late` is how long a stream waits."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of `gap`."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique_events(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def backfill_new(source: DataFrame, fill: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Takes what is new in a stream of rows once, fills it in and stores it, and ends. Each batch of a checkpoint has a
    folder of its own, which a repeated batch overwrites."""

    def batch(rows: DataFrame, number: int) -> None:
        own = f"{rows.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        fill(rows).write.mode("overwrite").parquet(f"{sink}/batch={own}")

    return source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()
