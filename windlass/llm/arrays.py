"""Array expressions that Spark lacks, from its own higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(values: Column) -> Column:
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    return F.aggregate(values, F.array().cast("array<int>"), lambda a, x: F.array_append(a, (last(a) + x).cast("int")))


def running_sums(values: Column) -> Column:
    """Running sums of an array of integers, in blocks, so that long arrays stay near linear."""
    blocks = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return let(
        F.transform(blocks, lambda b: _sums(F.slice(values, b * _BLOCK + 1, _BLOCK))),
        lambda local: let(
            _sums(F.transform(local, lambda s: F.element_at(s, -1))),
            lambda ends: F.flatten(F.transform(local, lambda s, k: F.transform(s, lambda x: x + F.coalesce(F.get(ends, k - 1), F.lit(0))))),
        ),
    )
