"""Counts, distributions and small reshapings over windows, splits, files and runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.operators import numbering
from windlass.operators.quality import violation


def distinct_per(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n): how many distinct keys each group has."""
    return rows.groupBy(group).agg(F.count_distinct(key).alias("n"))


def two_key_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with subtotals, in which the other key is null and ``level`` says which is left out."""
    return rows.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def histogram(rows: DataFrame, value: Column) -> DataFrame:
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def count_distribution(rows: DataFrame, key: str) -> DataFrame:
    """(rows_per_key, keys): how many keys have how many rows."""
    return rows.groupBy(key).agg(F.count("*").alias("rows_per_key")).groupBy("rows_per_key").agg(F.count("*").alias("keys"))


def retrieval_by_group(ranked: DataFrame, group: str, k: int = 5) -> DataFrame:
    """mrr, recall within ``k`` and mean error of ranked queries (group, rank, error) per group."""
    return ranked.groupBy(group).agg(
        F.count("*").alias("queries"), F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= k).cast("double")).alias("recall"), F.avg("error").alias("mean_error")
    )


def label_maps(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, counts): a map of each group's labels to their counts; nulls are not counted."""
    counted = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    return counted.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("counts"))


def directory_stats(files: DataFrame, directory: str, kind: str, size: str, required: list[str]) -> DataFrame:
    """Files, bytes and kinds of each directory, and which required kinds it lacks."""
    kinds = F.array_sort(F.collect_set(kind))
    return files.groupBy(directory).agg(
        F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"), F.array_join(kinds, "|").alias("kinds"),
        F.array_join(F.array_except(F.array(*map(F.lit, required)), kinds), "|").alias("missing"),
    )


def task_accuracy(rows: DataFrame, tasks: list[str], task: str = "task", correct: str = "correct") -> DataFrame:
    """(task, correct, n, share) for each of ``tasks``, those without a row included."""
    named = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, tasks))).alias("_t"))
    got = rows.groupBy(task).agg(F.sum(F.col(correct).cast("long")).alias("correct"), F.count("*").alias("n"))
    joined = named.join(got, F.col("_t") == F.col(task), "left").na.fill(0, ["correct", "n"])
    return joined.select(F.col("_t").alias("task"), "correct", "n", F.when(F.col("n") > 0, F.round(F.col("correct") / F.col("n"), 4)).alias("share"))


def in_splits(rows: DataFrame, wanted: list[str], split: str = "split", unspecified: bool = False) -> DataFrame:
    """The rows of ``wanted`` splits; with ``unspecified``, also those without one."""
    keep = F.col(split).isin(wanted)
    return rows.where(keep | F.coalesce(F.trim(split), F.lit("")).isin("", "unspecified") if unspecified else keep)


def reindexed(rows: DataFrame, label: str, groups: list[str], order: list[str]) -> DataFrame:
    """The rows with a label, numbered anew from 0 within ``groups``."""
    return numbering.by_order(rows.where(F.col(label).isNotNull()), groups, order).withColumn("index", F.col("_at") - 1).drop("_at", "_n")


def listed_values(rows: DataFrame, values: str, constants: Mapping[str, Column], expected: int) -> tuple[DataFrame, DataFrame]:
    """An array column as rows (step from 1, value) with constant columns, and the rows whose array
    does not have the expected length, which give none."""
    n = F.coalesce(F.size(values), F.lit(-1))
    flat = rows.where(n == expected).select(*rows.drop(values).columns, F.posexplode(values).alias("step", "value"))
    return flat.withColumn("step", F.col("step") + 1).withColumns(dict(constants)), rows.where(n != expected)


def alignment_violations(listed: DataFrame, arrays: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of a window list and of the arrays beside it that are missing on a side or differ."""
    a = listed.select(*keys, F.struct(*columns).alias("_a"))
    b = arrays.select(*keys, F.struct(*columns).alias("_b"))
    state = F.when(F.col("_a").isNull(), "only_in_arrays").when(F.col("_b").isNull(), "only_in_list").when(F.col("_a") != F.col("_b"), "differs")
    both = a.join(b, keys, "full_outer").withColumn("_s", state).where("_s is not null")
    return both.select(*violation("alignment", F.concat_ws("/", *keys), F.col("_s")))


def config_violations(configs: DataFrame, key: str, required: list[str], positive: list[str], allowed: Mapping[str, list]) -> DataFrame:
    """What is wrong with rows of settings: blank fields, numbers not above zero, values outside a list."""
    said = lambda bad, what: F.when(bad, F.lit(what))
    checks = [said(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"missing {c}") for c in required]
    checks += [said(~F.coalesce(F.col(c) > 0, F.lit(False)), f"not positive {c}") for c in positive]
    checks += [said(~F.coalesce(F.col(c).isin(v), F.lit(False)), f"unknown {c}") for c, v in allowed.items()]
    wrong = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return configs.select(F.col(key), F.explode(wrong).alias("_w")).select(*violation("config", F.col(key), F.col("_w")))


def table_violations(rows: DataFrame, manifest_rows: int, splits: list[str], split: str = "split") -> DataFrame:
    """A row count that differs from the manifest's, and splits without a row."""
    named = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, splits))).alias("_s"))
    empty = named.join(rows.select(F.col(split).alias("_s")).distinct(), "_s", "left_anti").select(*violation("empty_split", F.col("_s"), F.lit(0)))
    total = rows.agg(F.count("*").alias("n")).where(F.col("n") != manifest_rows)
    return empty.unionByName(total.select(*violation("row_count", F.lit("manifest"), F.concat_ws("/", "n", F.lit(manifest_rows)))))
