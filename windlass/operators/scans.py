"""Scans over rows in order that no key keeps in one task.

Rows are dealt to ranges of (groups, order) and written down once. Each range is scanned by itself;
what it would need from the ranges before or after it, one row a group and range, is scanned as a
small table and added. A group that holds all rows is as many tasks as any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.functions.lineage import cut

_BEFORE = (Window.unboundedPreceding, -1)


def laid(rows: DataFrame, groups: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with _b, the number of their range; ranges follow (groups, order)."""
    return cut(rows.repartitionByRange(*groups, *order).withColumn("_b", F.spark_partition_id()))


def _edges(ranged: DataFrame, groups: list[str], values: dict[str, Column]) -> DataFrame:
    return ranged.groupBy(*groups, "_b").agg(*[v.alias(n) for n, v in values.items()])


def _with(ranged: DataFrame, edges: DataFrame, groups: list[str]) -> DataFrame:
    """Every row beside what its group and range gets from the others; null groups are a group."""
    other = edges.withColumnsRenamed({g: f"_g{k}" for k, g in enumerate(groups)} | {"_b": "_b2"})
    on = reduce(Column.__and__, [ranged[g].eqNullSafe(other[f"_g{k}"]) for k, g in enumerate(groups)], ranged["_b"] == other["_b2"])
    return ranged.join(other, on).drop("_b2", *[f"_g{k}" for k in range(len(groups))])


def _over(groups: list[str], *more: str) -> Window:
    return Window.partitionBy(*[F.col(g) for g in (*groups, *more)] or [F.lit(0)])


def carry(rows: DataFrame, groups: list[str], order: list[Column | str], last: dict[str, str] | None = None, following: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with new columns by name: of ``last``, the latest value that is not null of a column
    up to the row itself; of ``following``, the first one after the row, in the order of the group.
    ``order`` is ascending, nulls first, and tells the rows apart that have values. What follows is
    what came last in the order turned round: a frame that is open to the end is summed anew at
    each row, and costs the square of a range's rows."""
    last, following = last or {}, following or {}
    ranged, place = laid(rows, groups, order), F.struct(*order)
    ends = {f"_l{k}": F.max_by(c, F.when(F.col(c).isNotNull(), place)) for k, c in enumerate(last.values())}
    ends |= {f"_f{k}": F.min_by(c, F.when(F.col(c).isNotNull(), place)) for k, c in enumerate(following.values())}
    across, back = _over(groups).orderBy("_b"), _over(groups).orderBy(F.desc("_b"))
    edges = _edges(ranged, groups, ends)
    edges = edges.select(
        *groups, "_b", *[F.last(f"_l{k}", ignorenulls=True).over(across.rowsBetween(*_BEFORE)).alias(f"_l{k}") for k in range(len(last))],
        *[F.last(f"_f{k}", ignorenulls=True).over(back.rowsBetween(*_BEFORE)).alias(f"_f{k}") for k in range(len(following))],
    )
    inside, turned = _over(groups, "_b").orderBy(*order), _over(groups, "_b").orderBy(*[F.desc(o) for o in order])
    local = ranged.withColumns(
        {f"_in_{n}": F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n, c in last.items()}
        | {f"_in_{n}": F.last(c, ignorenulls=True).over(turned.rowsBetween(*_BEFORE)) for n, c in following.items()}
    )
    met = _with(local, edges, groups)
    found = {n: F.coalesce(f"_in_{n}", f"_l{k}") for k, n in enumerate(last)} | {n: F.coalesce(f"_in_{n}", f"_f{k}") for k, n in enumerate(following)}
    return met.withColumns(found).drop("_b", *ends, *[f"_in_{n}" for n in (*last, *following)])


def running(rows: DataFrame, groups: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the running sums, the row included, of expressions by name; _at is the row's
    place in its group, from 1. Rows must differ in ``order``."""
    ranged = laid(rows.withColumns({f"_s{k}": c for k, c in enumerate(sums.values())} | {"_one": F.lit(1).cast("long")}), groups, order)
    names, held = [*sums, "_at"], [*(f"_s{k}" for k in range(len(sums))), "_one"]
    across, inside = _over(groups).orderBy("_b").rowsBetween(*_BEFORE), _over(groups, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    edges = _edges(ranged, groups, {f"_t{k}": F.sum(c) for k, c in enumerate(held)})
    edges = edges.select(*groups, "_b", *[F.coalesce(F.sum(f"_t{k}").over(across), F.lit(0)).alias(f"_t{k}") for k in range(len(held))])
    local = ranged.withColumns({c: F.sum(c).over(inside) for c in held})
    met = _with(local, edges, groups).withColumns({n: F.col(c) + F.col(f"_t{k}") for k, (n, c) in enumerate(zip(names, held, strict=True))})
    return met.drop("_b", *held, *[f"_t{k}" for k in range(len(held))])


def grouped_quantiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(groups, names of ``shares``): exact quantiles of each group, interpolated between
    neighbours. Counts by value are summed first; no task holds a group's distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c"))
    up_to = running(counts, groups, [value], {"_h": F.col("_c")})
    sizes = counts.groupBy(*groups).agg(F.sum("_c").alias("_n")).withColumnsRenamed({g: f"_g{k}" for k, g in enumerate(groups)})
    on = reduce(Column.__and__, [up_to[g].eqNullSafe(sizes[f"_g{k}"]) for k, g in enumerate(groups)])
    met = up_to.join(sizes, on)
    made = []
    for name, p in shares.items():
        place = (F.col("_n") - 1) * F.lit(p)
        at = lambda k: F.min(F.when(F.col("_h") > k, F.col(value).cast("double")))
        part = F.max(place - F.floor(place))
        made.append((at(F.floor(place)) * (1 - part) + at(F.ceil(place)) * part).alias(name))
    return met.groupBy(*groups).agg(*made)
