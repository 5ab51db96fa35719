"""Places of rows in the order of their group, without a group having to fit one task.

A group is dealt out to buckets that follow its order; rows are numbered inside each bucket, and
the sizes of the buckets before, a small table, are added. A plain window would put a group that
holds a third of all rows, or all of them, into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.functions.lineage import cut

#: Hex digits of a hash that name a bucket: 4096 buckets a group.
DIGITS = 3


def _number(bucketed: DataFrame, groups: list[str], order: list[Column | str]) -> DataFrame:
    sizes = bucketed.groupBy(*groups, "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*[F.col(g) for g in groups] or [F.lit(0)])
    before = sizes.select(
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_b").alias("_b2"),
        (F.sum("_c").over(whole.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_n"),
    )
    local = bucketed.withColumn("_at", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(*order)))
    on = reduce(Column.__and__, [local[g].eqNullSafe(before[f"_g{k}"]) for k, g in enumerate(groups)], local["_b"] == before["_b2"])
    placed = local.join(before, on).withColumn("_at", F.col("_at") + F.col("_before"))
    return placed.drop("_b", "_b2", "_before", *[f"_g{k}" for k in range(len(groups))])


def by_order(rows: DataFrame, groups: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with _at (from 1) by ``order`` within ``groups`` and _n, the group's size.

    Buckets are ranges of (groups, order) from Spark's own sampling; they are written down once,
    so that the count of a bucket and its rows always agree.
    """
    ranged = rows.repartitionByRange(*groups, *order)
    return _number(cut(ranged.withColumn("_b", F.spark_partition_id())), groups, order)


def by_hash(rows: DataFrame, groups: list[str], digest: Column, tie: str) -> DataFrame:
    """The same in the order of a hexadecimal hash, whose first digits name the bucket."""
    hashed = rows.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, DIGITS))
    return _number(hashed, groups, ["_h", tie]).drop("_h")


def running_counts(rows: DataFrame, value: str) -> DataFrame:
    """(value, _h, n): of each distinct value, how many rows are not above it, and of how many in all.

    Counts by value are summed first and dealt out by ranges of values; running sums are made
    inside each range, and the sums of the ranges before, a small table, are added.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    ranged = cut(counts.repartitionByRange(value).withColumn("_b", F.spark_partition_id()))
    whole = Window.partitionBy(F.lit(0))
    before = ranged.groupBy("_b").agg(F.sum("c").alias("_c")).select(
        F.col("_b").alias("_b2"), (F.sum("_c").over(whole.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("n")
    )
    local = ranged.withColumn("_h", F.sum("c").over(Window.partitionBy("_b").orderBy(value)))
    return local.join(before, F.col("_b") == F.col("_b2")).select(value, (F.col("_h") + F.col("_before")).alias("_h"), "n")


def quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of exact quantiles by name, interpolated between neighbours; nulls without a value.
    No task holds the distinct values of the column, as one that makes a percentile does."""
    at = lambda k: F.min(F.when(F.col("_h") > k, F.col(value).cast("double")))
    made = []
    for name, p in shares.items():
        place = (F.col("n") - 1) * F.lit(p)
        part = F.max(place - F.floor(place))
        made.append((at(F.floor(place)) * (1 - part) + at(F.ceil(place)) * part).alias(name))
    return running_counts(rows, value).agg(*made)
