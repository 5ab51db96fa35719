"""Rows that reports and viewers read: windows with what belongs to them, budgets, versions, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = ["episode_id", "window_index"]


def viewer_rows(windows: DataFrame, objects: DataFrame, fps: float, frames: tuple[str, ...] = ("start_frame", "end_frame", "center_frame")) -> DataFrame:
    """Windows with their frames in seconds and their objects (episode_id, window_index, objects:
    pipe-joined); a window without any has "" and 0."""
    listed = objects.select(*WINDOW, F.col("objects").alias("_o"))
    seconds = {c.replace("frame", "time_s"): F.round(F.col(c) / fps, 3) for c in frames}
    text = F.coalesce("_o", F.lit(""))
    count = F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"\|")))
    return windows.join(listed, WINDOW, "left").withColumns({**seconds, "objects": text, "object_count": count.cast("long")}).drop("_o")


def prediction_table(windows: DataFrame, predictions: DataFrame, tasks: list[str]) -> DataFrame:
    """Windows with a column for each task's prediction (episode_id, window_index, task, predicted),
    null where a task has none. One pivot and one join, however many tasks there are."""
    wide = predictions.groupBy(*WINDOW).pivot("task", tasks).agg(F.first("predicted"))
    return windows.join(wide, WINDOW, "left")


def conditionings(present: dict[str, Column]) -> Column:
    """The names, in their order, of the conditions that hold; null does not."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in present.items()]), lambda x: x.isNotNull())


def budget_phases(episodes: DataFrame, size: str, available: float, phases: list[tuple[str, int]], windows_per_episode: int, test_fraction: float = 0.2) -> DataFrame:
    """Which phases (name, episodes) fit ``available`` bytes at the mean size, and the windows of
    train and test; test episodes are rounded half to even, one at least."""
    mean = episodes.agg(F.avg(size).alias("_m"))
    most = F.when(F.col("_m") > 0, F.floor(F.lit(float(available)) / F.col("_m"))).otherwise(F.lit(0)).cast("long")
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("phase"), F.lit(k).cast("long").alias("episodes")) for n, k in phases]))
    rows = mean.select(most.alias("most_episodes"), listed.alias("p")).select("p.*", "most_episodes")
    test = F.when(F.col("episodes") > 1, F.greatest(F.lit(1), F.bround(F.col("episodes") * test_fraction))).otherwise(F.col("episodes")).cast("long")
    return rows.select(
        "phase", "episodes", "most_episodes", (F.col("episodes") <= F.col("most_episodes")).alias("feasible"),
        ((F.col("episodes") - test) * windows_per_episode).alias("train_windows"), (test * windows_per_episode).alias("test_windows"),
    )


def current_version(runs: DataFrame, group: str, run: str, validity: str, priority: dict[str, int]) -> DataFrame:
    """Per group the run of highest priority (0 if not listed), then validity (null: -1), then id."""
    rank = F.coalesce(*[F.when(F.col(run) == k, F.lit(v)) for k, v in priority.items()], F.lit(0))
    return runs.groupBy(group).agg(F.max_by(F.col(run), F.struct(rank.alias("p"), F.coalesce(F.col(validity), F.lit(-1.0)).alias("v"), F.col(run).alias("r"))).alias("current"))


def evaluation_state(rows: DataFrame, sources: dict[str, Column], total: Column, age: Column, stale_after: float) -> DataFrame:
    """``rows`` with the first source that has a count, and what is done, left and stale by it."""
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in sources.items()])
    done = F.coalesce(*sources.values())
    share = F.when(total > 0, F.round(done / total * 100, 2))
    state = F.when(age.isNull() | (age <= stale_after), "active").otherwise("stale")
    made = {"source": source, "completed": done, "remaining": F.greatest(F.lit(0), total - done), "percent_complete": share, "health": state}
    return rows.withColumns(made).where("source is not null")
