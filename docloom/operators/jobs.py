"""Jobs as events (job_id, ts, status, progress): latest state, elapsed time, ETA, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest(events: DataFrame) -> DataFrame:
    """The state of each job: its last event by time, then id; created_at, started_at, updated_at."""
    newest = F.max_by(F.struct("status", "progress", "event_id"), F.struct("ts", "event_id")).alias("s")
    started = F.min(F.when(F.col("status") == "running", F.col("ts")))
    g = events.groupBy("job_id").agg(newest, F.min("ts").alias("created_at"), started.alias("started_at"), F.max("ts").alias("updated_at"))
    return g.select("job_id", "s.status", "s.progress", "s.event_id", "created_at", "started_at", "updated_at")


def elapsed(jobs: DataFrame) -> DataFrame:
    """Whole seconds from a job's start to its last event; null before it starts."""
    return jobs.withColumn("elapsed_s", F.floor(F.unix_seconds("updated_at") - F.unix_seconds("started_at")))


def eta(progress: Column, elapsed_s: Column, status: Column) -> Column:
    """Seconds left at the rate so far; null unless the job runs at over 0.05 percent a second."""
    rate = F.when(elapsed_s > 0, progress / elapsed_s)
    return F.when((status == "running") & (rate > 0.05), F.ceil((100 - progress) / rate))


def without_deleted(jobs: DataFrame, tombstones: DataFrame) -> DataFrame:
    return jobs.join(tombstones.select("job_id").distinct(), "job_id", "left_anti")


def lookup(ids: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each asked id with its job's status, or the error "not found"."""
    return ids.join(jobs, "job_id", "left").select("job_id", "status", F.when(F.col("status").isNull(), F.lit("not found")).alias("error"))


def results(ids: DataFrame, jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Each asked id with its stored result (job_id, result), or the error "not ready" unless its job is done."""
    at = ids.join(jobs.select("job_id", "status"), "job_id", "left").join(stored.select("job_id", "result"), "job_id", "left")
    ready = F.coalesce(F.col("status") == "done", F.lit(False)) & F.col("result").isNotNull()
    return at.select("job_id", F.when(ready, F.col("result")).alias("result"), F.when(~ready, F.lit("not ready")).alias("error"))


def scores(ids: DataFrame, jobs: DataFrame, needs: DataFrame, profile: DataFrame) -> DataFrame:
    """Each asked id with the match of its result to the profile, made anew on each call: match_score,
    cost_feasibility, error. needs: job_id, needs, location, cost. profile: one row, or none yet."""
    from docloom.operators.scoring import baseline_match

    status = jobs.select("job_id", F.col("status").alias("_status"))
    at = ids.join(status, "job_id", "left").join(needs, "job_id", "left").join(profile.limit(1).withColumn("_has", F.lit(True)), F.lit(True), "left")
    ready = F.coalesce(F.col("_status") == "done", F.lit(False))
    error = F.when(~ready, F.lit("not ready")).when(F.col("_has").isNull(), F.lit("company profile not set"))
    return baseline_match(at).select("job_id", F.when(error.isNull(), F.col("match_score")).alias("match_score"), F.when(error.isNull(), F.col("cost_feasibility")).alias("cost_feasibility"), error.alias("error"))
