"""Sliding windows, labels and runs over frames.

Frames are rows (episode_id, frame_idx, label, ...), frame_idx from 0 without gaps; a null
label is a missing one. ``end_frame`` is inclusive. Everything is keyed by episode, so work is
spread over episodes; windows come from integer arithmetic on the frame's own index and never
from a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from windlass.operators import numbering, scans


def by_frame() -> WindowSpec:
    return Window.partitionBy("episode_id").orderBy("frame_idx")


def episode_lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("episode_id").agg(F.count("*").alias("n"))


def _span(start: Column, width: int | Column) -> list[Column]:
    width = F.lit(width) if isinstance(width, int) else width
    return [
        start.alias("start_frame"),
        (start + width - 1).alias("end_frame"),
        F.floor((2 * start + width - 1) / 2).alias("center_frame"),
    ]


def sliding_windows(lengths: DataFrame, width: int = 20, stride: int = 5) -> DataFrame:
    """Full windows only; an episode shorter than ``width`` has none."""
    starts = lengths.where(F.col("n") >= width).select("episode_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - width, F.lit(stride).cast("long"))).alias("window_index", "s"))
    return starts.select("episode_id", F.col("window_index").cast("long"), *_span(F.col("s"), width))


def multiscale_windows(lengths: DataFrame, scales: list[tuple[str, int, int]]) -> DataFrame:
    """Windows of several (scale_id, width, stride), with a row of nulls and ``skipped`` true
    for an episode too short for a scale."""
    listed = F.array(*[F.struct(F.lit(a).alias("scale_id"), F.lit(w).cast("long").alias("width"), F.lit(s).cast("long").alias("stride")) for a, w, s in scales])
    each = lengths.select("episode_id", "n", F.explode(listed).alias("c")).select("episode_id", "n", "c.*")
    starts = F.when(F.col("n") >= F.col("width"), F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("width"), F.col("stride")))
    found = each.select("episode_id", "scale_id", "width", F.posexplode_outer(starts).alias("window_index", "s"))
    return found.select("episode_id", "scale_id", F.col("window_index").cast("long"), *_span(F.col("s"), F.col("width"))[:2], F.col("s").isNull().alias("skipped"))


def window_estimate(lengths: DataFrame, width: int, stride: int) -> DataFrame:
    """How many windows each episode gives, in closed form."""
    return lengths.withColumn("n_windows", F.when(F.col("n") >= width, F.floor((F.col("n") - width) / stride) + 1).otherwise(F.lit(0)).cast("long"))


def window_members(frames: DataFrame, width: int = 20, stride: int = 5) -> DataFrame:
    """``frames`` repeated for each window that holds them, with window_index.

    The windows of a frame follow from its index; frames past the last full window belong to
    none and are dropped before ``sequence`` could count backwards.
    """
    n = F.count("*").over(Window.partitionBy("episode_id"))
    low = F.greatest(F.lit(0), F.ceil((F.col("frame_idx") - width + 1) / stride)).cast("long")
    high = F.least(F.floor(F.col("frame_idx") / stride), F.floor((F.col("_n") - width) / stride)).cast("long")
    bounded = frames.withColumn("_n", n).where(F.col("_n") >= width).withColumn("_lo", low).withColumn("_hi", high).where("_lo <= _hi")
    return bounded.withColumn("window_index", F.explode(F.sequence("_lo", "_hi"))).drop("_n", "_lo", "_hi")


def majority_label(frames: DataFrame, width: int = 20, stride: int = 5, least: float = 0.6) -> DataFrame:
    """Per window the most frequent label that is not missing, its share of those, and null for
    a share under ``least`` or without labels. Ties go to the label seen first in the window."""
    members = window_members(frames, width, stride)
    counted = members.groupBy("episode_id", "window_index", "label").agg(F.count("*").alias("c"), F.min("frame_idx").alias("first"))
    present = F.col("label").isNotNull()
    best = counted.groupBy("episode_id", "window_index").agg(
        F.sum(F.when(present, F.col("c")).otherwise(0)).alias("total"),
        F.max_by(F.when(present, F.struct("label", "c")), F.when(present, F.struct(F.col("c"), (-F.col("first")).alias("f")))).alias("b"),
    )
    share = F.coalesce(F.col("b.c") / F.col("total"), F.lit(0.0))
    start = F.col("window_index") * stride
    return best.select(
        "episode_id", "window_index", *_span(start, width), F.when(share >= least, F.col("b.label")).alias("label"), F.round(share, 6).alias("fraction")
    )


def window_flags(frames: DataFrame, width: int = 20, stride: int = 5) -> DataFrame:
    """Per window: whether ``contact`` holds anywhere, and whether it has more than one label."""
    return window_members(frames, width, stride).groupBy("episode_id", "window_index").agg(
        F.bool_or("contact").alias("any_contact"), (F.count_distinct("label") > 1).alias("transition")
    )


def object_sets(frames: DataFrame, width: int = 20, stride: int = 5) -> DataFrame:
    """Per window its labels in order of first sight, and by falling frequency, pipe-joined."""
    counted = window_members(frames, width, stride).where("label is not null").groupBy("episode_id", "window_index", "label").agg(F.count("*").alias("c"), F.min("frame_idx").alias("first"))
    return counted.groupBy("episode_id", "window_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]), "|").alias("by_first_seen"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "first", "label"))), lambda x: x["label"]), "|").alias("by_frequency"),
    )


def boundaries(frames: DataFrame) -> DataFrame:
    """Frames whose label and the one before are both present and differ."""
    before = F.lag("label").over(by_frame())
    return frames.withColumn("from_label", before).where(F.col("label").isNotNull() & F.col("from_label").isNotNull() & (F.col("label") != F.col("from_label"))).select(
        "episode_id", "frame_idx", "from_label", F.col("label").alias("to_label")
    )


def label_runs(frames: DataFrame) -> DataFrame:
    """Runs of one label, the missing one included, numbered within the episode."""
    changed = F.when(F.lag("label").over(by_frame()).eqNullSafe(F.col("label")) & (F.col("frame_idx") > 0), 0).otherwise(1)
    marked = frames.withColumn("_c", changed).withColumn("run_index", F.sum("_c").over(by_frame()) - 1)
    return marked.groupBy("episode_id", "run_index").agg(
        F.min("label").alias("label"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("frames")
    )


def run_progress(frames: DataFrame) -> DataFrame:
    """Each frame's place in its run, from 0 to 1; a run of one frame is at 0."""
    changed = F.when(F.lag("label").over(by_frame()).eqNullSafe(F.col("label")) & (F.col("frame_idx") > 0), 0).otherwise(1)
    run = Window.partitionBy("episode_id", "_r")
    marked = frames.withColumn("_c", changed).withColumn("_r", F.sum("_c").over(by_frame()))
    at, size = F.row_number().over(run.orderBy("frame_idx")) - 1, F.count("*").over(run)
    return marked.select("episode_id", "frame_idx", F.round(F.when(size > 1, at / (size - 1)).otherwise(0.0), 6).alias("progress"))


def future_label(windows: DataFrame, frames: DataFrame, ahead: int = 20) -> DataFrame:
    """The label ``ahead`` frames after each window's end, clamped to the episode's last frame."""
    n = episode_lengths(frames).withColumnRenamed("n", "_n")
    at = windows.join(n, "episode_id").withColumn("frame_idx", F.least(F.col("_n") - 1, F.col("end_frame") + ahead))
    return at.join(frames.select("episode_id", "frame_idx", F.col("label").alias("next_label")), ["episode_id", "frame_idx"], "left").select(
        "episode_id", "window_index", F.col("frame_idx").alias("target_frame"), "next_label"
    )


def next_window(windows: DataFrame, horizon: int = 1) -> DataFrame:
    """Pairs of a window and the one ``horizon`` later in its episode."""
    order = Window.partitionBy("episode_id").orderBy("start_frame")
    later = F.lead(F.struct("window_index", "start_frame", "label"), horizon).over(order)
    return windows.withColumn("_f", later).where("_f is not null").select(
        "episode_id", "window_index", "label", F.col("_f.window_index").alias("future_index"), F.col("_f.start_frame").alias("future_start"), F.col("_f.label").alias("future_label")
    )


def near_boundary(windows: DataFrame, bounds: DataFrame, tolerance: int = 10) -> DataFrame:
    """Windows with 1 where a boundary lies within ``tolerance`` frames of the center, else 0.

    Both sides meet on buckets of ``tolerance`` frames (one, for a tolerance of 0), so the join is
    an equality.
    """
    bucket = lambda c: F.floor(c / max(1, tolerance))
    keyed = windows.withColumn("_b", F.explode(F.array(*[bucket(F.col("center_frame")) + d for d in (-1, 0, 1)])))
    marks = bounds.select(F.col("episode_id").alias("_e"), F.col("frame_idx").alias("_f"), bucket(F.col("frame_idx")).alias("_k"))
    close = keyed.join(marks, (keyed["episode_id"] == marks["_e"]) & (keyed["_b"] == marks["_k"]) & (F.abs(keyed["center_frame"] - marks["_f"]) <= tolerance), "left_semi")
    hit = close.select("episode_id", "window_index").distinct().withColumn("_hit", F.lit(1))
    return windows.join(hit, ["episode_id", "window_index"], "left").withColumn("transition", F.coalesce("_hit", F.lit(0))).drop("_hit")


def order_pairs(windows: DataFrame) -> DataFrame:
    """Neighbouring windows in both orders: (a, b) true at even places, (b, a) false at odd."""
    later = F.lead("window_index").over(Window.partitionBy("episode_id").orderBy("window_index"))
    pairs = windows.withColumn("_b", later).where("_b is not null")
    made = F.array(
        F.struct((2 * F.col("window_index")).alias("place"), F.col("window_index").alias("first"), F.col("_b").alias("second"), F.lit(1).alias("in_order")),
        F.struct((2 * F.col("window_index") + 1).alias("place"), F.col("_b").alias("first"), F.col("window_index").alias("second"), F.lit(0).alias("in_order")),
    )
    return pairs.select("episode_id", F.explode(made).alias("p")).select("episode_id", "p.*")


def coin_pairs(windows: DataFrame, seed: str = "pairs") -> DataFrame:
    """Neighbouring windows, each pair in one order only, drawn by a hash of its place."""
    later = F.lead("window_index").over(Window.partitionBy("episode_id").orderBy("window_index"))
    coin = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "episode_id", "window_index"), 256), 1, 4), 16, 10).cast("long") % 2
    pairs = windows.withColumn("_b", later).where("_b is not null").withColumn("in_order", coin.cast("int"))
    a, b = F.col("window_index"), F.col("_b")
    return pairs.select("episode_id", F.when(F.col("in_order") == 1, a).otherwise(b).alias("first"), F.when(F.col("in_order") == 1, b).otherwise(a).alias("second"), "in_order")


def alignment_pairs(windows: DataFrame, shift: int = 8) -> DataFrame:
    """Pairs of a window with itself (aligned, 1) and with the one ``shift`` later (0)."""
    later = F.lead("window_index", shift).over(Window.partitionBy("episode_id").orderBy("window_index"))
    shifted = windows.withColumn("_b", later).where("_b is not null")
    return windows.select("episode_id", F.col("window_index").alias("first"), F.col("window_index").alias("second"), F.lit(1).alias("aligned")).unionByName(
        shifted.select("episode_id", F.col("window_index").alias("first"), F.col("_b").alias("second"), F.lit(0).alias("aligned"))
    )


def shift_stress(values: DataFrame, shifts: list[int]) -> DataFrame:
    """Mean absolute difference between (episode_id, window_index, x) and itself at each shift."""
    moved = values.select("episode_id", F.col("x").alias("x0"), "window_index", F.explode(F.array(*[F.lit(s).cast("long") for s in shifts])).alias("shift"))
    moved = moved.withColumn("_at", F.col("window_index") + F.col("shift"))
    other = values.select(F.col("episode_id").alias("_e"), F.col("window_index").alias("_w"), F.col("x").alias("x1"))
    met = moved.join(other, (moved["episode_id"] == other["_e"]) & (moved["_at"] == other["_w"]))
    return met.groupBy("shift").agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("x1") - F.col("x0"))), 6).alias("mean_abs_diff"))


def context_span(windows: DataFrame, lengths: DataFrame, frames: int = 120) -> DataFrame:
    """A clip of ``frames`` frames around each center, clamped to the episode."""
    n = lengths.withColumnRenamed("n", "_n")
    low = F.greatest(F.lit(0).cast("long"), F.least(F.col("center_frame") - frames // 2, F.col("_n") - frames))
    return windows.join(n, "episode_id").select("episode_id", "window_index", low.alias("context_start"), (F.least(F.col("_n"), low + frames) - 1).alias("context_end"))


def chronological_split(rows: DataFrame, fraction: float = 0.3, key: str = "episode_id", order: str = "window_index", gap: int = 0) -> DataFrame:
    """``split``: the last ``fraction`` of each key's rows test, the others train; at least one
    each. The count is rounded half to even. ``gap`` train rows before the cut become "purge"."""
    w = Window.partitionBy(key)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    k = F.greatest(F.lit(1), F.least(F.bround(n * (1 - fraction)), n - 1))
    return rows.withColumn("_k", k).withColumn("_at", at).withColumn("split", F.when(F.col("_at") > F.col("_k"), "test").when(F.col("_at") > F.col("_k") - gap, "purge").otherwise("train")).drop("_k", "_at")


def even_sample(rows: DataFrame, k: int, key: str = "episode_id", order: str = "frame_idx") -> DataFrame:
    """``k`` rows of each key, evenly spaced from the first to the last; all if it has fewer."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)) - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(1, k - 1)))
    return numbered.where((F.col("_n") <= k) | F.array_contains(places, F.col("_i").cast("long"))).drop("_n", "_i")


def forecast_targets(frames: DataFrame, windows: DataFrame, ahead: int = 10) -> DataFrame:
    """The signals of the ``ahead`` frames after each window, in order, less the first of them;
    windows without that many frames left are dropped."""
    want = windows.select("episode_id", "window_index", F.explode(F.sequence(F.col("end_frame") + 1, F.col("end_frame") + ahead)).alias("frame_idx"))
    met = want.join(frames.select("episode_id", "frame_idx", "signal"), ["episode_id", "frame_idx"])
    got = met.groupBy("episode_id", "window_index").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "signal"))).alias("f")).where(F.size("f") == ahead)
    return got.select("episode_id", "window_index", F.transform("f", lambda x: F.round(x["signal"] - F.col("f")[0]["signal"], 6)).alias("target"))


def motion_energy(windows: DataFrame, values: list[str]) -> DataFrame:
    """L2 distance of each window's ``values`` from the window before; 0 for the first."""
    w = Window.partitionBy("episode_id").orderBy("window_index")
    total = sum((F.pow(F.col(v) - F.coalesce(F.lag(v).over(w), F.col(v)), 2) for v in values), F.lit(0.0))
    return windows.withColumn("energy", F.sqrt(total))


def above_train_median(rows: DataFrame, value: str = "energy") -> DataFrame:
    """1 where ``value`` is at least the median over the train split."""
    middle = numbering.quantiles(rows.where("split = 'train'"), value, {"_m": 0.5})
    return rows.join(F.broadcast(middle)).withColumn("is_high", (F.col(value) >= F.col("_m")).cast("int")).drop("_m")


def carried_forward(frames: DataFrame, value: str) -> DataFrame:
    """``value`` with nulls replaced by the last one before that is not, carried over ranges of
    frames, so that an episode is many tasks."""
    return scans.carry(frames, ["episode_id"], ["frame_idx"], {"_kept": value}).withColumn(value, F.col("_kept")).drop("_kept")


def ego_motion(frames: DataFrame, vector: str = "vector", ahead: int = 4) -> DataFrame:
    """Frames that have another ``ahead`` frames later, with ``target``: its vector less their own."""
    later = frames.select("episode_id", (F.col("frame_idx") - ahead).alias("frame_idx"), F.col(vector).alias("_later"))
    return frames.join(later, ["episode_id", "frame_idx"]).withColumn("target", F.zip_with("_later", vector, lambda b, a: b - a)).drop("_later")
