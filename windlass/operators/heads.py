"""Heads by name: those fitted by descent, ridge and perceptrons, and the frequency prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.operators.descent import multilabel_predict, softmax_predict  # noqa: F401
from windlass.operators.perceptron import mlp_predict  # noqa: F401
from windlass.operators.ridge import ridge_classify, ridge_predict  # noqa: F401


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with weight: n / (classes * count of the row's class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return rows.join(counts.join(F.broadcast(total)), label).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def prior_predict(train: DataFrame, test: DataFrame, true: str = "true_set", most: int = 256, least: float = 0.1) -> DataFrame:
    """``test`` with predicted_set: the labels (the ``most`` frequent at most) that at least
    ``least`` of the train rows have."""
    n = train.agg(F.count("*").alias("_n"))
    counts = train.select(F.explode(F.array_distinct(true)).alias("l")).groupBy("l").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "l").limit(most)
    chosen = counts.join(F.broadcast(n)).where(F.col("c") >= least * F.col("_n")).agg(F.array_sort(F.collect_list("l")).alias("predicted_set"))
    return test.join(F.broadcast(chosen))
