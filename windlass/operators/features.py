"""Per-window and per-cloud feature summaries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.operators import scans
from windlass.operators.timeline import window_members


def finite(x: Column) -> Column:
    """NaN and infinities as 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def temporal_stats(frames: DataFrame, width: int = 20, stride: int = 5, value: str = "signal", digits: int = 6) -> DataFrame:
    """mean, std, min, max, last - first, and mean and std of the first differences, per window.
    Standard deviations are over the population; a window of one frame has differences of 0."""
    w = Window.partitionBy("episode_id").orderBy("frame_idx")
    stepped = frames.withColumn(value, finite(F.col(value))).withColumn("_d", F.col(value) - F.lag(value).over(w))
    first = F.col("frame_idx") == F.col("window_index") * stride
    members = window_members(stepped, width, stride).withColumn("_d", F.when(first, None).otherwise(F.col("_d")))
    r = lambda c, name: F.round(c, digits).alias(name)
    return members.groupBy("episode_id", "window_index").agg(
        r(F.avg(value), "mean"), r(F.stddev_pop(value), "std"), r(F.min(value), "min"), r(F.max(value), "max"),
        r(F.max_by(value, "frame_idx") - F.min_by(value, "frame_idx"), "delta"),
        r(F.coalesce(F.avg("_d"), F.lit(0.0)), "vel_mean"), r(F.coalesce(F.stddev_pop("_d"), F.lit(0.0)), "vel_std"),
    )


QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def cloud_summary(points: DataFrame, key: str, axes: list[str], digits: int = 6) -> DataFrame:
    """Per key and axis: mean, std, min, max, p10, p50, p90 (interpolated), and log1p of the size.
    Quantiles come from counts by ranges of (key, axis, value), so a key with all points is many tasks."""
    r = lambda c, name: F.round(c, digits).alias(name)
    each = []
    for a in axes:
        each += [r(F.avg(a), f"{a}_mean"), r(F.stddev_pop(a), f"{a}_std"), r(F.min(a), f"{a}_min"), r(F.max(a), f"{a}_max")]
    sums = points.groupBy(key).agg(*each, r(F.log1p(F.count("*")), "log_n"))
    long = points.select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("v")) for a in axes])).alias("s")).select(key, "s.axis", "s.v")
    found = scans.grouped_quantiles(long, [key, "axis"], "v", QUANTILES)
    wide = found.groupBy(F.col(key).alias("_k")).agg(*[r(F.max(F.when(F.col("axis") == a, F.col(p))), f"{a}_{p}") for a in axes for p in QUANTILES])
    return sums.join(wide, sums[key].eqNullSafe(wide["_k"]), "left").drop("_k").select(key, *[f"{a}_{p}" for a in axes for p in ("mean", "std", "min", "max", *QUANTILES)], "log_n")


def depth_summary(pixels: DataFrame, key: str, depth: str, confidence: str, digits: int = 6) -> DataFrame:
    """Stats of the finite depths above zero, their share, and of the confidence, which is
    divided by 255 where its maximum is above one. Quantiles are made as for clouds."""
    ok = ~F.isnan(depth) & (F.abs(depth) != float("inf")) & (F.col(depth) > 0)
    v = F.when(ok, F.col(depth))
    r = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), digits).alias(name)
    scale = F.when(F.max(confidence) > 1, 255.0).otherwise(1.0)
    sums = pixels.groupBy(key).agg(
        r(F.avg(v), "mean"), r(F.stddev_pop(v), "std"), r(F.min(v), "min"), r(F.max(v), "max"),
        r(F.avg(F.when(ok, 1.0).otherwise(0.0)), "valid_share"),
        r(F.avg(confidence) / scale, "conf_mean"), r(F.stddev_pop(confidence) / scale, "conf_std"), r(F.min(confidence) / scale, "conf_min"), r(F.max(confidence) / scale, "conf_max"),
    )
    found = scans.grouped_quantiles(pixels.select(key, v.cast("double").alias("v")), [key], "v", QUANTILES).withColumnRenamed(key, "_k")
    met = sums.join(found, sums[key].eqNullSafe(found["_k"]), "left")
    return met.select(sums[key], "mean", "std", "min", "max", *[r(F.col(p), p) for p in QUANTILES], "valid_share", "conf_mean", "conf_std", "conf_min", "conf_max")


def value_histogram(rows: DataFrame, key: str, value: str, low: float, high: float, bins: int = 8) -> DataFrame:
    """Share of each of ``bins`` equal bins by key; what lies outside counts in the end bins."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / (high - low) * bins))).cast("int")
    counted = rows.select(key, at.alias("bin")).groupBy(key, "bin").agg(F.count("*").alias("c"))
    return counted.withColumn("share", F.round(F.col("c") / F.sum("c").over(Window.partitionBy(key)), 6))


def image_summary(pixels: DataFrame, key: str, x: str, y: str, channels: list[str], grid: int = 8, size: int = 64) -> DataFrame:
    """Means and deviations of the channels, and the mean grey of a ``grid`` square of blocks."""
    grey = sum((F.col(c) for c in channels), F.lit(0.0)) / len(channels)
    block = F.floor(F.col(y) * grid / size) * grid + F.floor(F.col(x) * grid / size)
    cells = pixels.groupBy(key, block.alias("b")).agg(F.avg(grey).alias("g"), F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in channels], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in channels])
    n = F.sum("n")
    means = [F.round(F.sum(f"s_{c}") / n, 6).alias(f"{c}_mean") for c in channels]
    stds = [F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(f"q_{c}") / n - F.pow(F.sum(f"s_{c}") / n, 2))), 6).alias(f"{c}_std") for c in channels]
    return cells.groupBy(key).agg(*means, *stds, F.transform(F.array_sort(F.collect_list(F.struct("b", "g"))), lambda v: F.round(v["g"], 6)).alias("grid"))


def image_edges(pixels: DataFrame, key: str, x: str, y: str, grey: Column, digits: int = 6) -> DataFrame:
    """Mean and deviation of the horizontal and vertical gradient's magnitude of each image of
    (key, x, y, ...): half the difference of a pixel's two neighbours, at a border the step to
    the only one."""
    cells = pixels.groupBy(key, x, y).agg(F.avg(grey).alias("_g"))

    def slope(along: str, across: str) -> Column:
        w = Window.partitionBy(key, across).orderBy(along)
        low, high = F.lag("_g").over(w), F.lead("_g").over(w)
        return F.coalesce((high - low) / 2, high - F.col("_g"), F.col("_g") - low, F.lit(0.0))

    sloped = cells.withColumn("_x", F.abs(slope(x, y))).withColumn("_y", F.abs(slope(y, x)))
    r = lambda c, name: F.round(c, digits).alias(name)
    return sloped.groupBy(key).agg(r(F.avg("_x"), "x_mean"), r(F.avg("_y"), "y_mean"), r(F.stddev_pop("_x"), "x_std"), r(F.stddev_pop("_y"), "y_std"))


def audio_levels(samples: DataFrame, key: str, order: str, value: str, digits: int = 6) -> DataFrame:
    """Root mean square, mean magnitude, peak, zero-crossing rate and log energy per key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    marked = samples.withColumn("_z", F.when(F.col(value) * before < 0, 1.0).when(before.isNotNull(), 0.0))
    r = lambda c, name: F.round(c, digits).alias(name)
    return marked.groupBy(key).agg(
        r(F.sqrt(F.avg(F.col(value) * F.col(value))), "rms"), r(F.avg(F.abs(value)), "mean_abs"), r(F.max(F.abs(value)), "peak"),
        r(F.coalesce(F.avg("_z"), F.lit(0.0)), "zcr"), r(F.log(F.sum(F.col(value) * F.col(value)) + 1e-8), "log_energy"),
    )


def _spectra(rate: float, bands: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in batches:
            rows = []
            for key, values in zip(frame["key"], frame["samples"], strict=True):
                x = np.asarray(values, dtype=float)
                power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2 if len(x) else np.zeros(1)
                hz = np.fft.rfftfreq(max(1, len(x)), 1 / rate)
                total = power.sum() + 1e-12
                centroid = float((hz * power).sum() / total)
                width = float(np.sqrt(((hz - centroid) ** 2 * power).sum() / total))
                rolloff = float(hz[min(len(hz) - 1, int(np.searchsorted(np.cumsum(power), 0.85 * power.sum())))])
                # Triangles of equal width on the mel scale, 2595 log10(1 + f / 700).
                edges = 700 * (10 ** (np.linspace(0, np.log10(1 + rate / 2 / 700), bands + 2)) - 1)
                rise = (hz[None] - edges[:-2, None]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)[:, None]
                fall = (edges[2:, None] - hz[None]) / np.maximum(edges[2:] - edges[1:-1], 1e-9)[:, None]
                mel = np.log(np.maximum(0, np.minimum(rise, fall)) @ power + 1e-8)
                rows.append((key, centroid, width, rolloff, mel.tolist()))
            yield pd.DataFrame(rows, columns=["key", "centroid", "bandwidth", "rolloff", "log_mel"])

    return run


def spectral_summary(segments: DataFrame, rate: float, bands: int = 16) -> DataFrame:
    """(key, centroid, bandwidth, rolloff, log_mel) of (key, samples array): the Fourier transform
    has no built-in, so it runs in Arrow batches, one row a segment; nothing shuffles."""
    picked = segments.select(F.col("key").cast("long").alias("key"), F.col("samples").cast("array<double>").alias("samples"))
    return picked.mapInPandas(_spectra(rate, bands), "key long, centroid double, bandwidth double, rolloff double, log_mel array<double>")


def mel_triangles(rate: float, size: int, bands: int, low: float = 40.0):
    """Filters (bands, size // 2 + 1) evenly spaced on the mel scale, each at least a bin wide on
    either side of its peak and summing to one."""
    import numpy as np

    last = size // 2
    scale = lambda hz: 2595 * np.log10(1 + hz / 700)
    corners = 700 * (10 ** (np.linspace(scale(low), scale(rate / 2), bands + 2) / 2595) - 1)
    at = np.clip(np.floor((size + 1) * corners / rate), 0, last)
    left = at[:-2]
    peak = np.minimum(np.maximum(at[1:-1], left + 1), last)
    right = np.minimum(np.maximum(at[2:], peak + 1), last + 1)
    bins = np.arange(last + 1)
    rise = (bins - left[:, None]) / np.maximum(peak - left, 1)[:, None]
    fall = (right[:, None] - bins) / np.maximum(right - peak, 1)[:, None]
    filters = np.where(bins < peak[:, None], rise, fall).clip(0, 1)
    filters[(bins < left[:, None]) | (bins >= right[:, None])] = 0
    return filters / np.where(filters.sum(axis=1) < 1e-8, 1, filters.sum(axis=1))[:, None]


def _log_mel(rate: float, size: int, hop: int, bands: int):
    def embed(values, filters):
        import numpy as np

        x = np.nan_to_num(np.asarray(values, float), nan=0.0, posinf=0.0, neginf=0.0)
        if not len(x):
            return np.zeros(9 * bands + 12)
        whole = np.pad(x, (0, max(0, size - len(x))))
        frames = np.lib.stride_tricks.sliding_window_view(whole, size)[::hop] * np.hanning(size)
        mel = np.log1p(np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ filters.T)
        steps = np.diff(mel, axis=0) if len(mel) > 1 else np.zeros_like(mel)
        bands_ = [mel.mean(0), mel.std(0), mel.min(0), mel.max(0), *np.percentile(mel, (10, 50, 90), axis=0), steps.mean(0), steps.std(0)]
        loud, power = np.abs(x), np.mean(x * x)
        crossings = np.mean(x[1:] * x[:-1] < 0) if len(x) > 1 else 0.0
        parts = [p.mean() if len(p) else 0.0 for p in np.array_split(loud, 3)]
        wave = [np.sqrt(power), loud.mean(), loud.std(), loud.max(), crossings, np.log1p(power), *parts, parts[-1] - parts[0], len(x) / rate, len(mel)]
        return np.concatenate([*bands_, wave])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        filters = mel_triangles(rate, size, bands)
        for frame in batches:
            yield pd.DataFrame({"key": frame["key"], "embedding": [embed(v if v is not None else [], filters) for v in frame["samples"]]})

    return run


def log_mel_embedding(segments: DataFrame, rate: float, size: int = 1024, hop: int = 512, bands: int = 64) -> DataFrame:
    """(key, embedding) of (key, samples array): nine statistics of each of ``bands`` log-mel bands
    over the frames (mean, deviation, ends, percentiles 10, 50 and 90, mean and deviation of the
    steps), then twelve of the wave. All zeros without samples. The Fourier transform has no
    built-in, so it runs in Arrow batches, one row a segment; nothing shuffles."""
    picked = segments.select(F.col("key").cast("long").alias("key"), F.col("samples").cast("array<double>").alias("samples"))
    return picked.mapInPandas(_log_mel(rate, size, hop, bands), "key long, embedding array<double>")


def block_norms(rows: DataFrame, array: str) -> DataFrame:
    """L2 norm and mean magnitude of an array column, and the norm over the largest norm."""
    norm = F.sqrt(F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    mean = F.aggregate(array, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) / F.greatest(F.size(array), F.lit(1))
    normed = rows.withColumn("l2", norm).withColumn("mean_abs", mean)
    return normed.join(F.broadcast(normed.agg(F.max("l2").alias("_m")))).withColumn("l2_share", F.col("l2") / F.greatest("_m", F.lit(1e-12))).drop("_m")


def standardize(rows: DataFrame, values: list[str], split: str = "split") -> DataFrame:
    """``values`` less their train mean, over their train population deviation (1 if under 1e-6)."""
    stats = rows.where(F.col(split) == "train").agg(*[F.avg(v).alias(f"_m_{v}") for v in values], *[F.stddev_pop(v).alias(f"_s_{v}") for v in values])
    joined = rows.join(F.broadcast(stats))
    scaled = {v: (F.col(v) - F.col(f"_m_{v}")) / F.when(F.col(f"_s_{v}") < 1e-6, 1.0).otherwise(F.col(f"_s_{v}")) for v in values}
    return joined.withColumns(scaled).drop(*[f"_{k}_{v}" for v in values for k in "ms"])


def root_centered(joints: Column) -> Column:
    """Joints, an array of points, less the first."""
    return F.transform(joints, lambda p: F.zip_with(p, joints[0], lambda a, b: a - b))


def rectangular_finite(matrix: Column) -> Column:
    """Whether an array of arrays has rows of one length and no NaN or infinity."""
    return F.forall(matrix, lambda r: (F.size(r) == F.size(matrix[0])) & F.forall(r, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))))
