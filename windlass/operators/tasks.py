"""Task contracts: rows with features, a target and a split, fitted and measured.

A task takes rows (id, split, x, target) and gives rows (metric, value). Several tasks make a
suite, in which a task that fails is a row that says so and does not stop the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.functions.lineage import landed
from windlass.operators import descent, metrics, retrieval, ridge

TRAIN, TEST = "train", "test"


def measures(one: DataFrame) -> DataFrame:
    """(metric, value): the columns of a table of one row, as rows."""
    each = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]
    return one.select(F.explode(F.array(*each)).alias("m")).select("m.*")


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("split") == TRAIN), rows.where(F.col("split") == TEST)


def coded(rows: DataFrame, label: str = "label") -> tuple[DataFrame, list[str]]:
    """``rows`` that have a label, with its code y by sorted label, and the labels (a list of the
    model's size)."""
    labels = sorted(r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().collect())
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1 if labels else F.lit(None)
    return rows.where(F.col(label).isNotNull()).withColumn("y", place.cast("int")), labels


def classify(rows: DataFrame, label: str = "label", **settings) -> tuple[DataFrame, DataFrame]:
    """Softmax regression of ``label`` on x. Returns the scored test rows (true_label,
    predicted_label, confidence beside their own columns) and the measures: rows of both parts,
    classes, those only the test part has, accuracy, macro F1, the majority's accuracy and the
    fit's last train accuracy."""
    named, labels = coded(landed(rows), label)
    train, test = _parts(named)
    model = descent.fit_softmax(train, "y", "x", classes=len(labels), **settings)
    code = lambda c: F.get(F.array(*map(F.lit, labels)), F.col(c))
    scored = landed(descent.softmax_scores(model, test, "x").withColumn("true_label", code("y")).withColumn("predicted_label", code("predicted")).drop("probabilities", "x"))
    quality = metrics.classification(scored).select("accuracy", F.col("macro_f1_supported").alias("macro_f1"))
    majority = metrics.majority_baseline(train, test, label).select(F.col("accuracy").alias("majority_baseline_accuracy"))
    sizes = named.agg(F.count_if(F.col("split") == TRAIN).alias("num_train"), F.count_if(F.col("split") == TEST).alias("num_test"))
    unseen = test.select(label).distinct().join(train.select(label).distinct(), label, "left_anti").agg(F.count("*").alias("unseen_test_classes"))
    one = sizes.join(quality).join(majority).join(unseen).withColumns({"num_classes": F.lit(len(labels)), "train_final_accuracy": F.lit(model.history[-1]["train_accuracy"])})
    return scored, measures(one)


def decide(rows: DataFrame, target: str = "y", **settings) -> DataFrame:
    """Softmax regression of a target of 0 or 1; measures of binary decisions."""
    train, test = _parts(landed(rows))
    model = descent.fit_softmax(train, target, "x", classes=2, **settings)
    made = metrics.binary(descent.softmax_scores(model, test, "x"), target, "predicted")
    return measures(made.drop("tp", "tn", "fp", "fn"))


def relevant(rows: DataFrame, labels: list[str], **settings) -> DataFrame:
    """Multilabel regression of the sets ``true_set`` over ``labels``."""
    train, test = _parts(landed(rows))
    return measures(metrics.multilabel(descent.multilabel_predict(train, test, labels, vector="x", **settings), labels))


def _projected(rows: DataFrame, alpha: float) -> DataFrame:
    train, test = _parts(landed(rows))
    return landed(ridge.ridge_predict(train, test, "x", "y", alpha))


def regress(rows: DataFrame, alpha: float = 1.0, points: tuple[int, int] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Ridge regression of the array y: mse, mae and r2 over all of its numbers; with ``points``
    (steps, points of three numbers a step) the mean distance of points, and that of the last
    step. Predictions are clipped to ``low`` and ``high`` if given."""
    made = _projected(rows, alpha)
    if low is not None and high is not None:
        made = made.withColumn("predicted", F.transform("predicted", lambda v: F.greatest(F.lit(low), F.least(F.lit(high), v))))
    flat = made.select(F.posexplode(F.arrays_zip("y", "predicted")).alias("at", "p")).select("at", F.col("p.y").alias("t"), F.col("p.predicted").alias("p"))
    # The total is about each column's own mean; its sums come from one pass by column.
    by = flat.groupBy("at").agg(F.count("*").alias("n"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("ss"), F.sum((F.col("t") - F.col("p")) ** 2).alias("e"), F.sum(F.abs(F.col("t") - F.col("p"))).alias("a"))
    total = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    one = by.agg((F.sum("e") / F.sum("n")).alias("mse"), (F.sum("a") / F.sum("n")).alias("mae"), F.when(total > 0, 1 - F.sum("e") / total).otherwise(0.0).alias("r2"))
    if points:
        steps, each = points
        point = F.floor(F.col("at") / 3)
        gaps = made.select("id", F.posexplode(F.arrays_zip("y", "predicted")).alias("at", "p")).groupBy("id", point.alias("point")).agg(F.sqrt(F.sum((F.col("p.y") - F.col("p.predicted")) ** 2)).alias("gap"))
        one = one.join(gaps.agg(F.avg("gap").alias("mpjpe"), F.avg(F.when(F.col("point") >= (steps - 1) * each, F.col("gap"))).alias("final_frame_mpjpe")))
    return measures(one)


def retrieve(rows: DataFrame, alpha: float = 1.0, by_target: bool = False) -> DataFrame:
    """Project x into the space of y by ridge; each test row's projection looks for its own y among
    all test rows by cosine, or (``by_target``) its y for its projection."""
    made = _projected(rows, alpha)
    ask, held = ("y", "predicted") if by_target else ("predicted", "y")
    queries = made.select("id", F.col(ask).alias("vector"), F.col("id").alias("target"))
    return measures(retrieval.summary(retrieval.ranks(queries, made.select("id", F.col(held).alias("vector")))))


def ridge_decide(rows: DataFrame, target: str = "y", alpha: float = 1.0) -> DataFrame:
    """A two-class ridge classifier: accuracy, F1 and macro F1 over both classes."""
    train, test = _parts(landed(rows))
    scored = ridge.ridge_classify(train, test, 2, "x", target, alpha)
    both = scored.select(F.col(target).cast("string").alias("true_label"), F.col("predicted").cast("string").alias("predicted_label"))
    return measures(metrics.binary(scored, target, "predicted").select("accuracy", "f1").join(metrics.macro_f1_fixed(both, 2)))


def suite(spark: SparkSession, tasks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(task, status, metric, value, error) of ``tasks`` by name, each a call that gives measures. A
    task that raises is one row with its error; measures are written down as each task ends."""
    made, failed = [], []
    for name, run in tasks.items():
        try:
            made.append(landed(run().select(F.lit(name).alias("task"), F.lit("done").alias("status"), "metric", "value", F.lit(None).cast("string").alias("error"))))
        except Exception as e:  # a failed task is a row
            failed.append((name, "failed", None, None, str(e).strip().split("\n")[0][:500]))
    out = spark.createDataFrame(failed, "task string, status string, metric string, value double, error string")
    for part in made:
        out = out.unionByName(part)
    return out


def pair_column(a: str, b: str) -> Column:
    """Two vectors and the second less the first, one after the other."""
    return F.concat(F.col(a), F.col(b), F.zip_with(b, a, lambda y, x: y - x))
