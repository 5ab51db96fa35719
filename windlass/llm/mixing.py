"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import WORD, keeping, landed

DIMS = ("source", "lang", "topic")
#: Share of all tokens to draw, and the power that flattens observed shares into targets.
BUDGET, TEMPERATURE = 0.5, 0.5
SWEEPS, TOLERANCE = 60, 1e-8
#: Cells (source, lang, topic) up to this many are fitted on the driver, more as DataFrames.
MAX_CELLS = 100_000
SEED = "mix"

Targets = Mapping[str, Mapping[str | None, float]]


def topic(text: Column) -> Column:
    """A coarse topic by surface: the first rule that fits."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]"), "contact")
        .when(text.rlike(r"[Ll]icen[sc]ed? under|[Rr]eleased under"), "legal")
        .otherwise("prose")
    )


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone (without an id, on the text)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _shares(totals: dict, given: Mapping | None, temperature: float) -> dict:
    """Target shares of the values that have tokens: those given, or the observed ones flattened."""
    raw = {k: (given.get(k, 0.0) if given is not None else v**temperature) for k, v in totals.items() if v > 0}
    total = sum(raw.values())
    if total <= 0:
        raise ValueError("no value with tokens has a positive target")
    return {k: v / total for k, v in raw.items()}


def _fit_local(cells: list, targets: Targets, temperature: float, budget: float) -> list[tuple]:
    """(source, lang, topic, weight, probability) of each cell, from (…, tokens)."""
    import numpy as np

    tokens = np.array([c["tokens"] for c in cells], dtype=float)
    weight, total = np.ones(len(cells)), tokens.sum()
    codes, wanted = [], []
    for d in DIMS:
        values = {v: k for k, v in enumerate(dict.fromkeys(c[d] for c in cells))}
        code = np.array([values[c[d]] for c in cells])
        had = np.bincount(code, tokens, len(values))
        share = _shares(dict(zip(values, had, strict=True)), targets.get(d), temperature)
        codes.append(code)
        wanted.append(np.array([share.get(v, 0.0) for v in values]) * total)
    for _ in range(SWEEPS):
        was = weight.copy()
        for code, want in zip(codes, wanted, strict=True):
            have = np.bincount(code, weight * tokens, len(want))
            weight = weight * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[code]
        if np.max(np.abs(weight - was) / np.maximum(was, 1e-300), initial=0) < TOLERANCE:
            break
    low, high = 0.0, 1.0 / max(weight[weight > 0].min(initial=np.inf), 1e-300)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * weight) * tokens).sum() < budget * total else (low, mid)
    return [(c["source"], c["lang"], c["topic"], float(w), float(min(1.0, high * w))) for c, w in zip(cells, weight, strict=True)]


def _fit_spread(cells: DataFrame, targets: Targets, temperature: float, budget: float) -> DataFrame:
    """The same for more cells than the driver should hold. A cell's weight is the product of one
    factor for each dimension's value, so only these factors change from sweep to sweep: a step
    is a sum by value over the cells with the other two factors. Each step is a table of its own."""
    spark, total = cells.sparkSession, cells.agg(F.sum("tokens")).first()[0]
    cells = landed(cells.groupBy(*[_named(d) for d in DIMS]).agg(F.sum("tokens").alias("tokens")))
    factors, wants = {}, {}
    for d in DIMS:
        had = cells.groupBy(f"_{d}").agg(F.sum("tokens").alias("had"))
        if d in targets:
            given = spark.createDataFrame([(v, float(x)) for v, x in targets[d].items()], f"{d} string, raw double").select(_named(d), "raw")
            raw = had.join(given, f"_{d}", "left").select(f"_{d}", F.when(F.col("had") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0).alias("raw"))
        else:
            raw = had.select(f"_{d}", F.when(F.col("had") > 0, F.pow("had", F.lit(temperature))).otherwise(0.0).alias("raw"))
        mass = raw.agg(F.sum("raw")).first()[0]
        if not mass:
            raise ValueError("no value with tokens has a positive target")
        wants[d] = landed(raw.select(f"_{d}", (F.col("raw") * (total / mass)).alias("want")))
        factors[d] = landed(wants[d].select(f"_{d}", F.lit(1.0).alias(f"f_{d}")))
    weighted = lambda: functools.reduce(lambda x, d: x.join(factors[d], f"_{d}"), DIMS, cells)
    weight = functools.reduce(lambda x, d: x * F.col(f"f_{d}"), DIMS, F.lit(1.0))
    for _ in range(SWEEPS):
        moved, olds = 1.0, dict(factors)
        for d in DIMS:
            have = weighted().groupBy(f"_{d}").agg(F.sum(weight * F.col("tokens")).alias("have"))
            scaled = F.when(F.col("have") > 0, F.col(f"f_{d}") * F.col("want") / F.col("have")).otherwise(0.0)
            factors[d] = landed(factors[d].join(wants[d], f"_{d}").join(have, f"_{d}").select(f"_{d}", scaled.alias(f"f_{d}")))
        # The largest relative change of a cell's weight, by which the local fit stops too.
        was = functools.reduce(lambda x, d: x.join(olds[d].withColumnRenamed(f"f_{d}", f"o_{d}"), f"_{d}"), DIMS, weighted())
        old = functools.reduce(lambda x, d: x * F.col(f"o_{d}"), DIMS, F.lit(1.0))
        moved = was.agg(F.max(F.abs(weight - old) / F.greatest(old, F.lit(1e-300)))).first()[0]
        if moved < TOLERANCE:
            break
    fitted = landed(weighted().select(*[f"_{d}" for d in DIMS], "tokens", weight.alias("weight")))
    low, high = 0.0, 1.0 / fitted.where("weight > 0").agg(F.min("weight")).first()[0]
    for _ in range(60):
        mid = (low + high) / 2
        drawn = fitted.agg(F.sum(F.least(F.lit(1.0), F.col("weight") * mid) * F.col("tokens"))).first()[0]
        low, high = (mid, high) if drawn < budget * total else (low, mid)
    return fitted.select(*[F.when(~F.col(f"_{d}.missing"), F.col(f"_{d}.value")).alias(d) for d in DIMS], "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"))


def _named(d: str) -> Column:
    """A value as a key without nulls, so that plain joins meet nulls too."""
    return F.struct(F.coalesce(F.col(d), F.lit("")).alias("value"), F.col(d).isNull().alias("missing")).alias(f"_{d}")


def calibrate(
    cells: DataFrame, targets: Targets | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET, max_cells: int = MAX_CELLS
) -> tuple[DataFrame, bool]:
    """(source, lang, topic, weight, probability) per cell of (source, lang, topic, tokens), and
    whether the driver fitted it, which bounds its size by ``max_cells``.

    Weights are raked until the weighted tokens meet every margin's target. Probabilities are
    the weights times one factor, one at most, which draws ``budget`` of all tokens; where a
    cell is short of tokens (probability one) its margin's target can't be met in full. More
    cells than the driver should hold are fitted as DataFrames, by the same steps and stopping rule.
    """
    if any(set(v) == {None} for v in (targets or {}).values()):
        raise ValueError("a target needs a value that is not null")
    cells = landed(cells)
    schema = "source string, lang string, topic string, weight double, probability double"
    found = cells.limit(max_cells + 1).collect()
    if not found or not sum(c["tokens"] for c in found):
        if cells.where("tokens > 0").isEmpty():
            return cells.select(*DIMS, F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability")), False
    if len(found) <= max_cells:
        return cells.sparkSession.createDataFrame(_fit_local(found, targets or {}, temperature, budget), schema), True
    return landed(_fit_spread(cells, targets or {}, temperature, budget)), False


def mix(docs: DataFrame, targets: Targets | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET, seed: str = SEED, max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` with topic, tokens, weight, probability and sampled, every row kept.

    Null sources and languages are values of their own; a null text has no tokens. A document
    is sampled if its uniform number is below its cell's probability, so repeated rows share
    one fate and a rerun draws the same. Columns of those five names are replaced.
    """
    tagged = docs.drop("topic", "tokens", "weight", "probability", "sampled").withColumns(
        {"topic": topic(F.coalesce("text", F.lit(""))), "tokens": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")}
    )
    cells = tagged.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    table, bounded = calibrate(cells, targets, temperature, budget, max_cells)
    table = table.withColumnsRenamed({d: f"_{d}" for d in DIMS})
    on = [tagged[d].eqNullSafe(table[f"_{d}"]) for d in DIMS]
    joined = tagged.join(F.broadcast(table) if bounded else table, on).drop(*[table[f"_{d}"] for d in DIMS])
    return joined.withColumn("sampled", uniform(F.col("doc_id"), F.col("text"), seed) < F.col("probability"))


def draw(docs: DataFrame, **options: object) -> DataFrame:
    """The documents that ``mix`` samples, columns unchanged, whatever their names."""
    return keeping(docs, ("topic", "tokens", "weight", "probability", "sampled"), lambda d: mix(d, **options).where("sampled"))
