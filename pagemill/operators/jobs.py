"""Job states over an append-only event table.

``job_events``: job_id, version, created_at, updated_at, status, step, progress, error. A job's state is its
event with the highest version; changes are new events. ``now`` is always a parameter.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, those that a job ends in, and how far a stage is.
STATUSES = ("pending", "running", "completed", "failed")
ACTIVE, TERMINAL = ("pending", "running"), ("completed", "failed")
STAGE_PROGRESS = {"extract": 0.05, "order": 0.18, "layout": 0.28, "clean": 0.35, "review": 0.42, "saved": 0.50, "speech": 0.55, "done": 1.0}
SPEECH_SHARE = 0.43
FAILED_LEAST = 0.05
ORPHAN_GRACE_MINUTES = 10
SAFE_ID = r"\A[A-Za-z0-9][A-Za-z0-9_-]*\z"


def from_events(events: DataFrame) -> DataFrame:
    """Events of users as job events: a user is a job, the event's kind its status."""
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("version"), F.col("ts").alias("updated_at"), status.alias("status"), F.col("event_type").alias("step"), clamped_progress(k / 100, status).alias("progress"))


def clamped_progress(progress: Column, status: Column) -> Column:
    """Between 0 and 1; a failed job shows a little at least."""
    p = F.least(F.greatest(F.coalesce(progress, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(status == "failed", F.greatest(p, F.lit(FAILED_LEAST))).otherwise(p)


def speech_progress(inner: Column) -> Column:
    return F.lit(STAGE_PROGRESS["speech"]) + SPEECH_SHARE * F.least(F.greatest(inner, F.lit(0.0)), F.lit(1.0))


def latest(events: DataFrame) -> DataFrame:
    """Each job's state: a partial aggregate before the exchange, no window."""
    state = F.max_by(F.struct("updated_at", "status", "step", "progress"), "version")
    return events.groupBy("job_id").agg(state.alias("s"), F.min("updated_at").alias("created_at"), F.count(F.lit(1)).alias("changes")).select("job_id", "created_at", "s.updated_at", "s.status", "s.step", "s.progress", "changes")


def listed(jobs: DataFrame) -> DataFrame:
    """The newest first."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id"))


def newest(jobs: DataFrame) -> DataFrame:
    """The job that is shown first: the newest, if there is any."""
    return listed(jobs).limit(1)


def status_text(status: Column, progress: Column) -> Column:
    # What a state is called.
    named = F.when(status == "completed", "Completed").when(status == "failed", "Failed")
    return named.when(status == "running", F.format_string("Running · %.0f%%", F.bround(progress * 100, 0))).otherwise("Queued")


def new_job_id() -> Column:
    """128 random bits as hexadecimal digits; a different one for each row and each run."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def active_count(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count(F.lit(1)).alias("jobs"))


def expired(jobs: DataFrame, now: datetime, ttl_hours: float) -> DataFrame:
    """Jobs that ended and were created before the time to live; none if that is not positive. Oldest first."""
    if ttl_hours <= 0:
        return jobs.limit(0)
    return jobs.where(F.col("status").isin(*TERMINAL) & (F.col("created_at") < _before(now, ttl_hours * 60))).orderBy("created_at")


def orphans(folders: DataFrame, jobs: DataFrame, now: datetime, ttl_hours: float) -> DataFrame:
    """Folders (root, name, mtime) of no live job that are older than the time to live and ten minutes."""
    if ttl_hours <= 0:
        return folders.limit(0)
    old = folders.where(F.col("mtime") < _before(now, ttl_hours * 60 + ORPHAN_GRACE_MINUTES))
    return old.join(jobs.select(F.col("job_id").cast("string").alias("name")), "name", "left_anti")


def _before(now: datetime, minutes: float) -> Column:
    return (F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(int(minutes)))).cast("timestamp_ntz")


def inserted_if_absent(jobs: DataFrame, new: DataFrame) -> DataFrame:
    return jobs.unionByName(new.join(jobs.select("job_id"), "job_id", "left_anti").select(*jobs.columns))


def deleted(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the jobs of ``ids`` that have ended and whose id is safe; others stay."""
    gone = jobs.where(F.col("status").isin(*TERMINAL) & F.col("job_id").cast("string").rlike(SAFE_ID)).select("job_id").join(ids.select("job_id"), "job_id", "left_semi")
    return jobs.join(gone, "job_id", "left_anti")


def admitted(jobs: DataFrame, new: DataFrame, most_active: int = 10) -> DataFrame:
    """As many of ``new`` (with created_at), oldest first, as the queue has room for."""
    room = max(0, most_active - jobs.where(F.col("status").isin(*ACTIVE)).count())
    return new.orderBy("created_at", "job_id").limit(room)


#: Fixed value: which state may follow which.
TRANSITIONS = {"pending": ("running", "failed"), "running": ("completed", "failed"), "completed": (), "failed": ()}


def allowed(old: Column, new: Column) -> Column:
    pairs = [f"{a}>{b}" for a, then in TRANSITIONS.items() for b in (a, *then)]
    return old.isNull() | F.concat(old, F.lit(">"), new).isin(*pairs)
