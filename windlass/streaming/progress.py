"""Run progress from append-only event logs, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

LOG_SCHEMA = "run_id string, event string, timestamp double, global_step bigint, total_steps bigint, loss double"


def _summary() -> list[Column]:
    when = lambda e: F.coalesce(F.bool_or(F.col("event") == e), F.lit(False))
    step = F.col("event") == "step"
    stepped = lambda f, c, by: f(F.when(step, F.col(c)), F.when(step, F.col(by)))
    return [
        F.max("global_step").alias("last_step"), F.max("total_steps").alias("total_steps"), F.min("timestamp").alias("started"), F.max("timestamp").alias("latest"),
        stepped(F.min_by, "loss", "global_step").alias("first_loss"), stepped(F.max_by, "loss", "global_step").alias("final_loss"),
        F.min("loss").alias("min_loss"), F.max("loss").alias("max_loss"), when("complete").alias("complete"), when("failed").alias("failed"),
    ]


def _outlook(rows: DataFrame) -> DataFrame:
    """Steps per second and seconds left; null before the first step."""
    took = F.col("latest") - F.col("started")
    rate = F.when(took > 0, F.col("last_step") / took)
    left = F.when(F.col("complete"), 0.0).otherwise((F.col("total_steps") - F.col("last_step")) / rate)
    state = F.when(F.col("failed"), "failed").when(F.col("complete"), "complete").when(F.col("last_step").isNotNull(), "running").otherwise("waiting")
    return rows.withColumn("steps_per_second", rate).withColumn("seconds_left", left).withColumn("state", state)


def run_summary(log: DataFrame) -> DataFrame:
    """One row a run: steps, losses, state, rate and time left."""
    return _outlook(log.groupBy("run_id").agg(*_summary()))


def freshness(files: DataFrame, now: Column, stale_after: float = 600.0) -> DataFrame:
    """Age in seconds of (path, modified) and whether it is past ``stale_after``."""
    age = now.cast("timestamp").cast("double") - F.col("modified").cast("double")
    return files.withColumn("age_seconds", age).withColumn("stale", age > stale_after)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """Log files (JSON lines) of a folder as a stream; new files are taken up as they come."""
    return spark.readStream.schema(LOG_SCHEMA).json(folder)


def watch(log: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
    """The running summary of a streamed log, rewritten as it changes. State is a row a run; a
    restart goes on from the checkpoint."""
    return log.groupBy("run_id").agg(*_summary()).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of (ts, event_type, value) in tumbling windows, for batches and streams:
    an extension. A window is final once the watermark has passed it; later rows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of (ts, user_id): runs of events less than ``gap`` apart; an extension."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        F.col("session_window.start").alias("session_start"), "user_id", "n"
    )


class RunFailed(RuntimeError):
    """A run has said that it failed."""


class RunStale(RuntimeError):
    """A run has said nothing for too long."""


WATCHED = "run_id string, state string, last_step bigint, total_steps bigint, latest double"


def run_states(log: DataFrame, stale_after: float) -> DataFrame:
    """The states of a streamed log's runs as they change: (run_id, state, last_step, total_steps,
    latest), state one of running, stale, complete and failed.

    Each run has one row of keyed state and a timer on the clock: events set it anew, and if none
    come for ``stale_after`` seconds the run is said to be stale, once; later events make it run
    again. A run that has ended keeps no state. Restarts go on from the query's checkpoint.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        last, total, latest = state.get if state.exists else (None, None, None)
        if state.hasTimedOut:
            told = "stale"
            state.update((last, total, latest))
        else:
            told, seen = "running", set()
            for rows in batches:
                seen |= set(rows["event"].dropna())
                top = lambda now, c: max((int(x) for x in [*rows[c].dropna(), *([] if now is None else [now])]), default=None)  # noqa: B023, E731
                last, total = top(last, "global_step"), top(total, "total_steps")
                latest = max((float(x) for x in [*rows["timestamp"].dropna(), *([] if latest is None else [latest])]), default=None)
            told = "failed" if "failed" in seen else "complete" if "complete" in seen else told
            if told == "running":
                state.update((last, total, latest))
                state.setTimeoutDuration(max(1, int(stale_after * 1000)))
            elif state.exists:
                state.remove()
        frame = pd.DataFrame({"run_id": [key[0]], "state": [told], "last_step": pd.array([last], "Int64"), "total_steps": pd.array([total], "Int64"), "latest": [latest]})
        yield frame

    held = "last_step bigint, total_steps bigint, latest double"
    return log.where("run_id is not null").groupBy("run_id").applyInPandasWithState(step, WATCHED, held, "update", GroupStateTimeout.ProcessingTimeTimeout)


def wait_for(log: DataFrame, runs: list[str], checkpoint: str, timeout: float, stale_after: float, every: str = "1 second") -> dict[str, dict]:
    """Follow a streamed log until all of ``runs`` are complete, and return their last states. Raises
    RunFailed or RunStale as soon as one of them is, and TimeoutError after ``timeout`` seconds."""
    import time

    known: dict[str, dict] = {}

    def take(batch: DataFrame, _: int) -> None:
        for r in batch.where(F.col("run_id").isin(runs)).collect():  # a row of each run that was asked for
            known[r["run_id"]] = r.asDict()

    query = run_states(log, stale_after).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    until = time.monotonic() + timeout
    try:
        while True:
            states = {k: v["state"] for k, v in list(known.items())}
            for told, error in (("failed", RunFailed), ("stale", RunStale)):
                bad = sorted(k for k, v in states.items() if v == told)
                if bad:
                    raise error(f"{told}: {', '.join(bad)}")
            if all(states.get(k) == "complete" for k in runs):
                return dict(known)
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > until:
                raise TimeoutError(f"not complete after {timeout} s: {', '.join(k for k in runs if states.get(k) != 'complete')}")
            time.sleep(0.2)
    finally:
        query.stop()
