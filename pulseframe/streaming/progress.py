"""Latest progress per command from a stream (or table) of worker events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_SCHEMA = ("schema STRING, event STRING, command STRING, phase STRING, progress DOUBLE, message STRING,"
                " timestamp TIMESTAMP")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """JSON event lines as a stream."""
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


def latest_progress(events: DataFrame, command: str = "command", at: str = "timestamp") -> DataFrame:
    """Last phase and progress (clamped to 0..1) per command and the number of events.

    The same plan runs on a table and on a stream; the state is one row per command.
    """
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "progress"))
    # Order by time, then by the values, so that equal times have one answer.
    newest = F.max(F.struct(F.col(at).alias("at"), progress.alias("progress"), F.col("phase").alias("phase")))
    return (events.where(F.col("progress").isNotNull()).groupBy(F.col(command).alias("command"))
            .agg(newest.alias("m"), F.count(F.lit(1)).alias("events"))
            .select("command", F.col("m.phase").alias("phase"), F.col("m.progress").alias("progress"), F.col("m.at").alias("last_event"), "events"))


def start_progress(events: DataFrame, sink: str, checkpoint: str):
    """Keep the table ``sink`` (in memory) at the latest progress per command."""
    return (latest_progress(events).writeStream.outputMode("complete").format("memory").queryName(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def store_progress(events: DataFrame, path: str, checkpoint: str):
    """Write the commands that moved in each micro-batch under ``path``; a repeated batch overwrites its own rows."""
    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (latest_progress(events).writeStream.outputMode("update").foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stored_progress(spark: SparkSession, path: str) -> DataFrame:
    """The latest stored progress per command; nothing is held on the driver."""
    rows = spark.read.schema("command STRING, phase STRING, progress DOUBLE, last_event TIMESTAMP, events LONG, batch LONG").parquet(path)
    newest = F.max_by(F.struct("phase", "progress", "last_event", "events"), "batch")
    return rows.groupBy("command").agg(newest.alias("m")).select("command", "m.*")
