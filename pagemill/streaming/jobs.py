"""Job states and progress as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.shipping import ship
from pagemill.operators.jobs import FAILED_LEAST, TERMINAL, TRANSITIONS

PREFIX = "PROGRESS "
_STATE = "status string, step string, progress double, created_at timestamp, updated_at timestamp, version bigint"
STATES = f"job_id bigint, {_STATE}"


def progress_events(lines: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Progress of prefixed JSON lines in ``value``: malformed ones are left out, values stay between 0 and 1."""
    body = F.from_json(F.expr(f"substring(value, {len(prefix) + 1})"), "progress double, step string")
    found = lines.where(F.col("value").startswith(prefix)).withColumn("_p", body).where("_p.progress is not null")
    return found.select(*[c for c in lines.columns if c != "value"], F.least(F.greatest(F.col("_p.progress"), F.lit(0.0)), F.lit(1.0)).alias("progress"), F.coalesce("_p.step", F.lit("")).alias("step"))


def advance(state: tuple | None, events: list[tuple]) -> tuple | None:
    """A job's state after events (updated_at, status, step, progress) in order of time, then of their other values.

    A change that the state machine doesn't allow is ignored; every change that counts adds a version.
    """
    for at, status, step, progress in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3] or 0.0)):
        value = min(max(progress or 0.0, 0.0), 1.0)
        if status == "failed":
            value = max(value, FAILED_LEAST)
        if state is None:
            state = (status, step, value, at, at, 1)
        elif status == state[0] and status not in TERMINAL or status in TRANSITIONS[state[0]]:
            state = (status, step, value, state[3], at, state[5] + 1)
    return state


def job_states(events: DataFrame, ttl_hours: float = 24.0, late: str = "10 minutes") -> DataFrame:
    """Each job's state whenever it changes; a job that has ended is forgotten after its time to live.

    ``events``: job_id, updated_at, status, step, progress.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(events.sparkSession)

    def update(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        old = tuple(state.get) if state.exists else None
        rows = [t for pdf in frames for t in zip(pdf.updated_at, pdf.status, pdf.step, pdf.progress, strict=True)]
        new = advance(old, rows)
        if new is None or new == old:
            return
        state.update(new)
        mark = state.getCurrentWatermarkMs()
        if new[0] in TERMINAL:
            state.setTimeoutTimestamp(max(mark + 1, int(new[3].timestamp() * 1000) + int(ttl_hours * 3_600_000)))
        yield pd.DataFrame([(key[0], *new)], columns=["job_id", "status", "step", "progress", "created_at", "updated_at", "version"])

    watched = events.withWatermark("updated_at", late)
    return watched.groupBy("job_id").applyInPandasWithState(update, STATES, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_to_table(states: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None):
    """Write each change of a stream of states to ``path``, a folder for each batch; the query that does so.

    A batch that runs again after a failure replaces its own folder. ``trigger``: as for ``writeStream``; all that is there, then the end, by default.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """Of each job its last state, of what ``run_to_table`` wrote."""
    rows = spark.read.schema(f"{STATES}, batch int").parquet(path)
    last = F.max_by(F.struct("status", "step", "progress", "created_at", "updated_at", "version"), "version")
    return rows.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")


def changed_since(states: DataFrame, version: int) -> DataFrame:
    """What a viewer that has seen ``version`` has to draw again: nothing if nothing changed."""
    return states.where(F.col("version") > version)
