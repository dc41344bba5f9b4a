"""Queries of job states, over ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pagemill.functions.shared import work_folder
from pagemill.operators import jobs as J
from pagemill.plans.registry import query
from pagemill.streaming import jobs as S

_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"
_PROGRESS = "least(greatest(coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100, 0.0), 0.0), 1.0)"
_SQL = f"""WITH event AS (
  SELECT user_id AS job_id, ts, event_id, {_STATUS} AS status, event_type AS step, CASE WHEN event_type = 'error' THEN greatest({_PROGRESS}, 0.05) ELSE {_PROGRESS} END AS progress FROM events
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k, min(ts) OVER (PARTITION BY job_id) AS created_at, count(*) OVER (PARTITION BY job_id) AS changes FROM event
), job AS (
  SELECT job_id, created_at, ts AS updated_at, status, step, progress, changes FROM ranked WHERE k = 1
)"""
#: Fixed, so that the same rows come out on any day; the tables' events are of that year.
NOW = datetime(2024, 1, 20)


def latest(spark, sf_dir):
    return J.latest(J.from_events(spark.read.parquet(f"{sf_dir}/events.parquet")))


@query("jobs_latest", f"{_SQL} SELECT job_id, created_at, updated_at, status, step, progress, changes FROM job")
def jobs_latest(spark, sf_dir):
    return latest(spark, sf_dir)


@query("jobs_list", f"{_SQL} SELECT job_id, created_at, status FROM job ORDER BY created_at DESC, job_id DESC")
def jobs_list(spark, sf_dir):
    return J.listed(latest(spark, sf_dir)).select("job_id", "created_at", "status")


@query("jobs_active", f"{_SQL} SELECT count(*) FILTER (status IN ('pending', 'running')) AS active, count(*) AS jobs FROM job")
def jobs_active(spark, sf_dir):
    return J.active_count(latest(spark, sf_dir))


@query("jobs_expired", f"{_SQL} SELECT job_id, created_at, status FROM job WHERE status IN ('completed', 'failed') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR")
def jobs_expired(spark, sf_dir):
    return J.expired(latest(spark, sf_dir), NOW, 24).select("job_id", "created_at", "status")


def folders(spark, sf_dir):
    """A folder for every event's number; those beyond the users' have no job."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.lit("outputs").alias("root"), F.col("event_id").cast("string").alias("name"), F.col("ts").alias("mtime"))


@query("jobs_orphans", f"{_SQL} SELECT CAST(event_id AS VARCHAR) AS name, ts AS mtime FROM events e WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR - INTERVAL 10 MINUTE AND NOT EXISTS (SELECT 1 FROM job j WHERE j.job_id = e.event_id)")
def jobs_orphans(spark, sf_dir):
    return J.orphans(folders(spark, sf_dir), latest(spark, sf_dir), NOW, 24).select("name", "mtime")


@query("jobs_insert_if_absent", f"{_SQL} SELECT job_id, status FROM job UNION ALL SELECT event_id, 'completed' FROM events e WHERE NOT EXISTS (SELECT 1 FROM job j WHERE j.job_id = e.event_id)")
def jobs_insert_if_absent(spark, sf_dir):
    jobs = latest(spark, sf_dir).select("job_id", "status")
    new = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("job_id"), F.lit("completed").alias("status"))
    return J.inserted_if_absent(jobs, new)


@query("jobs_deleted", f"{_SQL} SELECT job_id, status FROM job WHERE NOT (status IN ('completed', 'failed') AND job_id % 2 = 0)")
def jobs_deleted(spark, sf_dir):
    jobs = latest(spark, sf_dir).select("job_id", "status")
    return J.deleted(jobs, jobs.where(F.pmod("job_id", F.lit(2)) == 0))


_LINES = "CASE event_id % 4 WHEN 0 THEN 'PROGRESS {\"progress\": ' || value || ', \"step\": \"' || event_type || '\"}' WHEN 1 THEN 'PROGRESS {broken' WHEN 2 THEN 'note ' || event_type ELSE 'PROGRESS {\"step\": \"none\"}' END"


@query("progress_events", "SELECT event_id, least(greatest(value, 0.0), 1.0) AS progress, event_type AS step FROM events WHERE event_id % 4 = 0 AND value IS NOT NULL")
def progress_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.progress_events(e.select("event_id", F.expr(_LINES).alias("value")))


@query("speech_progress", f"SELECT event_id, round(0.55 + 0.43 * {_PROGRESS}, 9) AS progress FROM events")
def speech_progress(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double") / 100, F.lit(0.0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(J.speech_progress(k), 9).alias("progress"))


#: Which state may follow which, as text.
_MOVES = "(" + ", ".join(f"'{a}>{b}'" for a, then in J.TRANSITIONS.items() for b in then) + ")"


_SQL_STATES = f"""WITH RECURSIVE event AS (
  SELECT user_id AS job_id, ts, {_STATUS} AS status, event_type AS step, {_PROGRESS} AS p FROM events
), ranked AS (
  SELECT job_id, ts, status, step, CASE WHEN status = 'failed' THEN greatest(p, 0.05) ELSE p END AS p, row_number() OVER (PARTITION BY job_id ORDER BY ts, status, step, p) AS k FROM event
), state AS (
  SELECT job_id, k, status, step, p AS progress, ts AS created_at, ts AS updated_at, CAST(1 AS BIGINT) AS version FROM ranked WHERE k = 1
  UNION ALL
  SELECT s.job_id, r.k, CASE WHEN moves THEN r.status ELSE s.status END, CASE WHEN moves THEN r.step ELSE s.step END, CASE WHEN moves THEN r.p ELSE s.progress END, s.created_at, CASE WHEN moves THEN r.ts ELSE s.updated_at END, s.version + CASE WHEN moves THEN 1 ELSE 0 END
  FROM state s JOIN ranked r ON r.job_id = s.job_id AND r.k = s.k + 1,
       LATERAL (SELECT (r.status = s.status AND s.status IN ('pending', 'running')) OR s.status || '>' || r.status IN {_MOVES} AS moves)
), ended AS (
  SELECT job_id, status, step, round(progress, 9) AS progress, created_at, updated_at, version FROM (SELECT *, max(k) OVER (PARTITION BY job_id) AS last FROM state) WHERE k = last
)"""


def streamed_states(spark, sf_dir):
    """All events as a stream through the state machine, to the end; the last state of each job."""
    path, folder = f"{sf_dir}/events.parquet", work_folder(spark, "job-stream")
    # a pattern, because a stream takes a file's path for a folder's
    events = J.from_events(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet"))
    states = S.job_states(events.select("job_id", F.col("updated_at").cast("timestamp").alias("updated_at"), "status", "step", "progress"))
    S.run_to_table(states, f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    found = S.latest_states(spark, f"{folder}/states")
    return found.select("job_id", "status", "step", F.round("progress", 9).alias("progress"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "version")


@query("job_stream", f"{_SQL_STATES} SELECT * FROM ended")
def job_stream(spark, sf_dir):
    return streamed_states(spark, sf_dir)


@query("job_stream_changes", f"{_SQL_STATES} SELECT job_id, status, version FROM ended WHERE version > 2")
def job_stream_changes(spark, sf_dir):
    """What a viewer that has seen every job's second version has to draw again."""
    return S.changed_since(streamed_states(spark, sf_dir), 2).select("job_id", "status", "version")
