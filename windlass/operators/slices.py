"""Error analysis by slice, and comparisons of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.operators.metrics import f1, ratio, signed_delta


def error_slices(rows: DataFrame, slices: list[str], exact: list[str], objects: tuple[str, str] | None = None) -> DataFrame:
    """Per value of each slicing column, in one pass over ``rows``: samples, the rate of each 0/1
    column of ``exact``, and object precision, recall and F1 of a pair of array columns.

    An array column slices by each of its distinct members. Every row is listed once for each
    slice it is in, and partial sums keep the shuffle at a row per group and task.
    """
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    name = lambda c, v: F.struct(F.lit(c).alias("slice"), v.cast("string").alias("group"))
    members = lambda c: F.transform(F.array_distinct(c), lambda v: name(c, v))
    parts = [members(c) if kinds[c] == "array" else F.array(name(c, F.col(c))) for c in slices]
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in exact]
    if objects:
        t, p = objects
        sums += [F.sum(F.size(F.array_intersect(t, p))).alias("_tp"), F.sum(F.size(t)).alias("_t"), F.sum(F.size(p)).alias("_p")]
    listed = rows.select("*", F.explode(F.concat(*parts)).alias("_s"))
    made = listed.groupBy("_s.slice", "_s.group").agg(F.count("*").alias("samples"), *sums)
    out = [F.round(F.col(c) / F.col("samples"), 6).alias(f"{c}_rate") for c in exact]
    if objects:
        pr, re = ratio(F.col("_tp"), F.col("_p")), ratio(F.col("_tp"), F.col("_t"))
        out += [F.round(pr, 6).alias("object_precision"), F.round(re, 6).alias("object_recall"), F.round(f1(pr, re), 6).alias("object_f1")]
    return made.select("slice", "group", "samples", *out)


def family_summary(rows: DataFrame, family: str, seen: str, correct: str) -> DataFrame:
    """Samples, share of seen labels and accuracy by family, the largest families first."""
    return rows.groupBy(family).agg(
        F.count("*").alias("samples"), F.round(F.avg(F.col(seen).cast("double")), 6).alias("seen_share"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy")
    ).orderBy(F.desc("samples"), family)


def singleton_share(rows: DataFrame, label: str) -> DataFrame:
    """How many labels there are and which share of them occurs once."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("c"))
    return counts.agg(F.count("*").alias("labels"), F.round(F.avg((F.col("c") == 1).cast("double")), 6).alias("singleton_share"))


def label_cardinality(rows: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Per split: labels, and those of them that train lacks. One grouping by label."""
    per = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.collect_set(split).alias("in"))
    listed = per.select(F.explode("in").alias(split), F.array_contains("in", "train").alias("_t"))
    return listed.groupBy(split).agg(F.count("*").alias("labels"), F.sum((~F.col("_t")).cast("long")).alias("not_in_train"))


def top_labels(rows: DataFrame, label: str, order: str, split: str = "split", k: int = 20) -> DataFrame:
    """The ``k`` most frequent labels of each split, the first seen first on a tie."""
    from pyspark.sql import Window

    counts = rows.where(F.col(label).isNotNull()).groupBy(split, label).agg(F.count("*").alias("n"), F.min(order).alias("_f"))
    place = F.row_number().over(Window.partitionBy(split).orderBy(F.desc("n"), "_f"))
    return counts.withColumn("place", place).where(F.col("place") <= k).drop("_f")


def compare_variants(scores: DataFrame, base: str, variant: str, higher: Column) -> DataFrame:
    """Scores (task, variant, score) of two variants side by side with gain and verdict; a task
    that lacks one has nulls."""
    wide = scores.groupBy("task").pivot("variant", [base, variant]).agg(F.first("score")).withColumnsRenamed({base: "base", variant: "other"})
    return wide.select("*", *[c.alias(n) for n, c in signed_delta(F.col("base"), F.col("other"), higher).items()])


def improvement(compared: DataFrame) -> DataFrame:
    return compared.agg(F.round(F.avg("gain"), 6).alias("mean_gain"), F.sum((F.col("gain") > 0).cast("long")).alias("improved"), F.count("gain").alias("tasks"))


def best_group(scores: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Per task the group of the highest score, the first by name on a tie; with ``allowed``,
    among rows for which it holds."""
    rows = scores.where(allowed) if allowed is not None else scores
    return rows.groupBy("task").agg(F.min(F.struct((-F.col("score")).alias("s"), "group")).alias("b")).select("task", "b.group", (-F.col("b.s")).alias("score"))
