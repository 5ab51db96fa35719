"""The driver tables seen as episodes, frames and windows, in Spark and (for checks) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlass.operators import timeline

#: Event type that stands for a missing label.
MISSING = "error"
WIDTH, STRIDE = 20, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: a user is an episode, its events in time order are frames."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_id"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_idx"),
        F.when(F.col("event_type") != MISSING, F.col("event_type")).alias("label"),
        F.col("value").alias("signal"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def windows(spark: SparkSession, sf_dir: str, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    return timeline.sliding_windows(timeline.episode_lengths(frames(spark, sf_dir)), width, stride)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


SQL_FRAMES = f"""frames AS (
  SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         CASE WHEN event_type <> '{MISSING}' THEN event_type END AS label, value AS signal,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
lens AS (SELECT episode_id, count(*) AS n FROM frames GROUP BY 1)"""


def sql_windows(name: str = "windows", width: int = WIDTH, stride: int = STRIDE) -> str:
    return f"""{name} AS (
  SELECT episode_id, CAST(s / {stride} AS BIGINT) AS window_index, s AS start_frame, s + {width - 1} AS end_frame, (2 * s + {width - 1}) // 2 AS center_frame
  FROM (SELECT episode_id, unnest(range(0, n - {width} + 1, {stride})) AS s FROM lens WHERE n >= {width}))"""


SQL_BASE = f"""WITH {SQL_FRAMES},
{sql_windows()},
members AS (
  SELECT w.*, f.frame_idx, f.label, f.signal, f.k FROM windows w
  JOIN frames f ON f.episode_id = w.episode_id AND f.frame_idx BETWEEN w.start_frame AND w.end_frame)"""

SQL_MAJORITY = """,
counted AS (SELECT episode_id, window_index, start_frame, end_frame, center_frame, label, count(*) AS c, min(frame_idx) AS f FROM members GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY episode_id, window_index ORDER BY (label IS NULL), c DESC, f) AS r,
         sum(CASE WHEN label IS NOT NULL THEN c ELSE 0 END) OVER (PARTITION BY episode_id, window_index) AS total
  FROM counted),
majority AS (
  SELECT episode_id, window_index, start_frame, end_frame, center_frame,
         CASE WHEN label IS NOT NULL AND c / total >= 0.3 THEN label END AS label, CASE WHEN label IS NULL THEN 0.0 ELSE round(c / total, 6) END AS fraction
  FROM ranked WHERE r = 1)"""
