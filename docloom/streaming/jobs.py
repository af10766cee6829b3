"""The streaming twin of the job table: the latest state of each job, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def job_events(raw: DataFrame) -> DataFrame:
    """Events as job events: signup queues, view and click run, purchase is done, error is an error."""
    status = (
        F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "done").otherwise("error")
    )
    progress = F.least(F.floor("value").cast("int"), F.lit(100))
    return raw.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), progress.alias("progress"))


def latest_stream(events: DataFrame) -> DataFrame:
    """The state of each job in update mode. One row of state is kept for each job, for ever: a job may go on
    at any time, so no watermark can drop it (the grouping has no event time). Jobs that are deleted leave
    by ``jobs.without_deleted`` where the result is read."""
    newest = F.max_by(F.struct("status", "progress", "event_id"), F.struct("ts", "event_id")).alias("s")
    return events.groupBy("job_id").agg(newest, F.max("ts").alias("updated_at"))


def throughput_stream(events: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by status in windows of time, final once the watermark has passed them."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n"))


def read_landing(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Files of a landing folder, as uploads arrive, whatever their suffix."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_trigger).schema(schema).load(path)
