"""Job queries over events: users as jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import jobs as J
from docloom.registry import query, table
from docloom.streaming.jobs import job_events

_EVENTS = """ev AS (
  SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'error' END AS status,
    least(cast(floor(value) AS INT), 100) AS progress FROM events),
jobs AS (
  SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress, arg_max(event_id, (ts, event_id)) AS event_id, min(ts) AS created_at,
    min(CASE WHEN status = 'running' THEN ts END) AS started_at, max(ts) AS updated_at FROM ev GROUP BY 1)"""
_ELAPSED = "cast(floor(epoch(updated_at)) - floor(epoch(started_at)) AS BIGINT)"


def _jobs(spark, sf):
    return J.latest(job_events(table(spark, sf, "events")))


@query(f"WITH {_EVENTS} SELECT job_id, status, progress, event_id FROM jobs")
def job_latest_status(spark, sf):
    return _jobs(spark, sf).select("job_id", "status", "progress", "event_id")


@query(f"WITH {_EVENTS} SELECT job_id, status, {_ELAPSED} AS elapsed_s FROM jobs")
def job_elapsed(spark, sf):
    return J.elapsed(_jobs(spark, sf)).select("job_id", "status", "elapsed_s")


@query(f"WITH {_EVENTS} SELECT job_id, status, progress, row_number() OVER (ORDER BY created_at DESC, job_id) AS place FROM jobs QUALIFY place <= 50")
def jobs_list(spark, sf):
    """The latest 50 jobs, as the list shows them."""
    top = _jobs(spark, sf).orderBy(F.desc("created_at"), "job_id").limit(50)
    from pyspark.sql import Window as W

    return top.select("job_id", "status", "progress", F.row_number().over(W.orderBy(F.desc("created_at"), "job_id")).cast("long").alias("place"))


@query(f"WITH {_EVENTS} SELECT job_id, status FROM jobs WHERE job_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)")
def jobs_delete(spark, sf):
    gone = table(spark, sf, "events").filter("event_type = 'error' AND value > 60").select(F.col("user_id").alias("job_id"))
    return J.without_deleted(_jobs(spark, sf), gone).select("job_id", "status")


@query(f"WITH {_EVENTS} SELECT DISTINCT a.o_custkey AS job_id, status, CASE WHEN status IS NULL THEN 'not found' END AS error FROM (SELECT DISTINCT o_custkey FROM orders) a LEFT JOIN jobs ON job_id = o_custkey")
def job_lookup(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id")).distinct()
    return J.lookup(ids, _jobs(spark, sf))


@query(
    f"""WITH {_EVENTS}, e AS (SELECT job_id, status, progress, {_ELAPSED} // 3600 AS elapsed_s FROM jobs),
r AS (SELECT *, CASE WHEN elapsed_s > 0 THEN progress / cast(elapsed_s AS DOUBLE) END AS rate FROM e)
SELECT job_id, CASE WHEN status = 'running' AND rate > 0.05 THEN cast(ceil((100 - progress) / rate) AS BIGINT) END AS eta_s FROM r"""
)
def job_eta(spark, sf):
    jobs = J.elapsed(_jobs(spark, sf)).withColumn("elapsed_s", F.floor(F.col("elapsed_s") / 3600))
    return jobs.select("job_id", J.eta(F.col("progress"), F.col("elapsed_s"), F.col("status")).alias("eta_s"))


@query(
    f"""WITH {_EVENTS}, asked AS (SELECT DISTINCT o_custkey AS job_id FROM orders), stored AS (SELECT c_custkey AS job_id, c_name AS result FROM customer)
SELECT a.job_id, CASE WHEN status = 'done' THEN result END AS result, CASE WHEN coalesce(status, '') <> 'done' OR result IS NULL THEN 'not ready' END AS error
FROM asked a LEFT JOIN jobs j ON j.job_id = a.job_id LEFT JOIN stored s ON s.job_id = a.job_id"""
)
def job_result(spark, sf):
    """Customers' names as stored results, asked for by the customers of orders."""
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id")).distinct()
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("result"))
    return J.results(ids, _jobs(spark, sf), stored)


@query(
    f"""WITH {_EVENTS}, needs AS (SELECT c_custkey AS job_id, [c_mktsegment, cast(c_nationkey % 3 AS VARCHAR)] AS needs, cast(c_nationkey AS VARCHAR) AS location, c_acctbal AS cost FROM customer),
m AS (
  SELECT n.job_id, j.status, cost, 60.0::DOUBLE * len(list_filter(needs, lambda x: x IN ('BUILDING', 'MACHINERY', '1'))) / 2
    + CASE WHEN location IN ('1', '2', '3', '5', '8') THEN 20 ELSE 0 END + CASE WHEN cost <= 5000 THEN 20 ELSE 0 END AS points, list_contains(needs, 'FURNITURE') AS excluded
  FROM needs n LEFT JOIN jobs j USING (job_id))
SELECT job_id, CASE WHEN status = 'done' THEN CASE WHEN excluded THEN 0 ELSE cast(floor(points + 0.5) AS INT) END END AS match_score,
  CASE WHEN status = 'done' THEN CASE WHEN cost <= 2500 THEN 'High' WHEN cost <= 5000 THEN 'Medium' ELSE 'Low' END END AS cost_feasibility,
  CASE WHEN coalesce(status, '') <> 'done' THEN 'not ready' END AS error FROM m"""
)
def job_score(spark, sf):
    """Customers as results that are held against one profile."""
    needs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("job_id"), F.array("c_mktsegment", (F.col("c_nationkey") % 3).cast("string")).alias("needs"), F.col("c_nationkey").cast("string").alias("location"), F.col("c_acctbal").alias("cost")
    )
    words = lambda *w: F.array(*map(F.lit, w))
    profile = spark.range(1).select(words("BUILDING", "MACHINERY", "1").alias("capabilities"), words("1", "2", "3", "5", "8").alias("locations"), words("FURNITURE").alias("exclusions"), F.lit(5000.0).alias("budget"))
    return J.scores(needs.select("job_id"), _jobs(spark, sf), needs, profile)
