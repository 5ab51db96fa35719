"""Joins that need more than an equality: as-of, nearest, range, coverage and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.operators import scans


def asof_forward(queries: DataFrame, table: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each query (key, at) with ``value`` of the first row at or after it (the smallest of those at
    one time), or of the key's last row if there is none. Both sides are laid out by key and time
    in ranges, so a key's rows are many tasks, and what is next is carried over the ranges."""
    q = queries.select("*", F.lit(None).cast(table.schema[value].dataType).alias(value), F.lit(0).alias("_q"))
    both = q.unionByName(table.select(key, at, value, F.lit(1).alias("_q")), allowMissingColumns=True)
    found = scans.carry(both, [key], [at, "_q", value], {"_last": value}, {"_next": value}).where("_q = 0")
    return found.withColumn(value, F.coalesce("_next", "_last")).drop("_q", "_next", "_last")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Frames that two spans with inclusive ends share."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1)


def nearest_window(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Each dense window with the sparse one of its episode whose center is nearest; then the one
    with the larger overlap, then the first. Adds source_index, source_start, source_end, kind,
    center_distance, overlap_frames and its shares of both.

    The nearest is the last one centered at or before, or the first one after: two values carried
    over both kinds in ranges of their centers, instead of a join of all pairs; an episode is as
    many tasks as its rows fill. Of windows with one center the widest overlaps most and starts first.
    """
    twice = F.col("start_frame") + F.col("end_frame")
    spot = F.struct(F.col("window_index").alias("index"), F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    s = sparse.withColumn("_c", twice).groupBy("episode_id", "_c").agg(F.min_by(spot, F.struct("start_frame", "window_index")).alias("_s"))
    both = dense.withColumn("_c", twice).withColumn("_q", F.lit(1)).unionByName(s.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    def ranked(x: Column) -> Column:
        gap = F.abs(x["start"] + x["end"] - F.col("_c")) / 2.0
        less = -overlap(F.col("start_frame"), F.col("end_frame"), x["start"], x["end"])
        return F.when(x.isNotNull(), F.struct(gap.alias("gap"), less.alias("less"), x["start"].alias("source_start"), x["index"].alias("source_index"), x["end"].alias("source_end")))

    placed = scans.carry(both, ["episode_id"], ["_c", "_q"], {"_before": "_s"}, {"_after": "_s"}).where("_q = 1")
    found = placed.withColumn("b", F.least(ranked(F.col("_before")), ranked(F.col("_after")))).where("b is not null")
    kind = (
        F.when((F.col("b.source_start") == F.col("start_frame")) & (F.col("b.source_end") == F.col("end_frame")), "exact_sparse_window")
        .when(F.col("b.less") < 0, "overlap_nearest_sparse_window")
        .otherwise("gap_nearest_sparse_window")
    )
    size = lambda a, b: F.greatest(F.col(b) - F.col(a) + 1, F.lit(1))
    return found.select(
        *dense.columns, "b.source_index", "b.source_start", "b.source_end", kind.alias("kind"), F.col("b.gap").alias("center_distance"), (-F.col("b.less")).alias("overlap_frames"),
        F.round(-F.col("b.less") / size("start_frame", "end_frame"), 6).alias("share_of_dense"), F.round(-F.col("b.less") / size("b.source_start", "b.source_end"), 6).alias("share_of_source"),
    )


def in_range(spans: DataFrame, points: DataFrame, key: str, low: str, high: str, at: str, bucket: int = 64) -> DataFrame:
    """Pairs of a span and the points of its key in [low, high). Spans are listed once for each
    bucket they touch and points fall in one, so it is an equality join with a filter."""
    keyed = spans.where(F.col(high) > F.col(low)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor((F.col(high) - 1) / bucket))))
    placed = points.withColumn("_b", F.floor(F.col(at) / bucket))
    return keyed.join(placed, [key, "_b"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def coverage(samples: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Samples with ``covered``: whether a prediction has their key."""
    done = predictions.select(F.col(key).alias("_k")).distinct().withColumn("_d", F.lit(True))
    return samples.join(done, samples[key] == done["_k"], "left").withColumn("covered", F.coalesce("_d", F.lit(False))).drop("_k", "_d")


def pending(samples: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    return samples.join(predictions.select(key), key, "left_anti")


def unseen(test: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels of ``test`` that ``train`` lacks."""
    return test.select(label).where(F.col(label).isNotNull()).distinct().join(train.select(label), label, "left_anti")


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys found in more than one split, with those splits: one grouping, no self-join."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), "|").alias("splits"), F.count_distinct(split).alias("n")).where("n > 1").drop("n")


def parity(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows that differ between two listings: missing on a side, or with another digest."""
    a, b = left.select(key, F.col(digest).alias("left_digest"), F.lit(1).alias("_l")), right.select(key, F.col(digest).alias("right_digest"), F.lit(1).alias("_r"))
    state = F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left").when(~F.col("left_digest").eqNullSafe(F.col("right_digest")), "differs")
    return a.join(b, key, "full_outer").withColumn("state", state).where("state is not null").drop("_l", "_r")


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``duplicate``: false for the first of each key by ``order``."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def prefer_left(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``left`` with nulls of ``columns`` filled from the row of ``right`` with its key."""
    named = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = left.join(named, key, "left")
    return joined.withColumns({c: F.coalesce(c, f"_r_{c}") for c in columns}).drop(*[f"_r_{c}" for c in columns])


def first_by_priority(rows: DataFrame, key: str, value: str, priority: Column) -> DataFrame:
    """The value of least priority number per key."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(priority.alias("p"), F.col(value).alias("v"))).alias(value))
