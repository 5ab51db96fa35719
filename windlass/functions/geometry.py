"""Quaternions (w, x, y, z), rotations and small vector algebra as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def q_inverse(q: Column) -> Column:
    return let(q, _inverse)


def _inverse(q: Column) -> Column:
    n = q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]
    return F.array(q[0] / n, -q[1] / n, -q[2] / n, -q[3] / n)


def q_multiply(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: _product(p["a"], p["b"]))


def _product(a: Column, b: Column) -> Column:
    return F.array(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def rotation_vector(q: Column) -> Column:
    """Axis times angle of a unit quaternion, by the shorter way round."""
    return let(q, _vector)


def _vector(q: Column) -> Column:
    s = F.when(q[0] < 0, -1.0).otherwise(1.0)
    v = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    factor = F.when(v < 1e-12, 2.0 * s).otherwise(2 * F.atan2(v, q[0] * s) / v * s)
    return F.array(q[1] * factor, q[2] * factor, q[3] * factor)


def continuous_signs(poses: DataFrame, q: str = "quat", key: str = "episode_id", order: str = "frame_number") -> DataFrame:
    """Quaternions with signs flipped so that neighbours never point apart: the number of raw
    neighbours so far that do decides a row's sign, which is one running sum."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(q).over(w)
    dot = F.aggregate(F.zip_with(q, before, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    flips = F.sum(F.when(F.col("_d") < 0, 1).otherwise(0)).over(w)
    return poses.withColumn("_d", dot).withColumn("_s", F.when(flips % 2 == 1, -1.0).otherwise(1.0)).withColumn(q, F.transform(q, lambda x: x * F.col("_s"))).drop("_d", "_s")


def chunk_pairs(start: Column, end: Column, chunk: int) -> Column:
    """``chunk`` pairs of frames evenly along a span, rounded half to even, each at least one long."""
    at = F.transform(F.sequence(F.lit(0), F.lit(chunk)), lambda i: F.bround(start + (end - start) * i / chunk).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(chunk - 1)), lambda i: F.struct(F.get(at, i).alias("left"), F.greatest(F.get(at, i + 1), F.get(at, i) + 1).alias("right")))


def unit(v: Column, floor: float = 1e-8) -> Column:
    n = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(floor))
    return F.transform(v, lambda x: x / n)


def sigmoid(x: Column, clip: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), x))))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def pad(v: Column, size: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(v))))


def frame_to_sample(frame: Column, fps: float, rate: float) -> Column:
    return F.bround(frame / fps * rate).cast("long")
