"""Evaluation metrics as aggregates. 0/0 is 0 unless said otherwise.

Macro F1 comes in four readings that differ on purpose: over classes with support, over all
that are true or predicted anywhere, over a given list of labels besides, and over a fixed
number of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.operators import scans


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def confusion(rows: DataFrame, true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    return rows.groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(F.count("*").alias("n"))


def confusion_wide(rows: DataFrame, classes: list[str], true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    return rows.groupBy(true).pivot(predicted, classes).count().na.fill(0)


def per_class(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """label, support, predicted, tp, precision, recall, f1 of every label seen in (true_label,
    predicted_label), and of those in ``labels`` (label) besides.

    Both marginals come from one pass: each row counts once as a true and once as a predicted
    label, with partial sums before the shuffle.
    """
    hit = (F.col("true_label") == F.col("predicted_label")).cast("long")
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("h")),
        F.struct(F.col("predicted_label").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("h")),
    )
    counted = rows.select(F.explode(sides).alias("s")).select("s.*").where("label is not null")
    if labels is not None:
        counted = counted.unionByName(labels.select("label", F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("h")))
    summed = counted.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return summed.select("label", "support", "predicted", "tp", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def classification(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: n, accuracy, macro F1 over supported classes, over seen ones and (with ``labels``)
    over all listed, weighted F1 and balanced accuracy."""
    table = per_class(rows, labels)
    seen, has = (F.col("support") > 0) | (F.col("predicted") > 0), F.col("support") > 0
    avg = lambda c, cond: F.coalesce(F.avg(F.when(cond, c)), F.lit(0.0))
    return table.agg(
        F.sum("support").alias("n"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        avg(F.col("f1"), has).alias("macro_f1_supported"),
        avg(F.col("f1"), seen).alias("macro_f1_seen"),
        avg(F.col("f1"), F.lit(True)).alias("macro_f1_listed"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        avg(F.col("recall"), has).alias("balanced_accuracy"),
    )


def macro_f1_fixed(rows: DataFrame, classes: int) -> DataFrame:
    """Macro F1 with the F1 sum over ``classes``, whether seen or not."""
    return per_class(rows).agg((F.sum("f1") / classes).alias("macro_f1"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy on ``test`` of the most frequent label of ``train`` (the smaller on a tie)."""
    best = train.groupBy(label).agg(F.count("*").alias("c")).orderBy(F.desc("c"), label).limit(1).select(F.col(label).alias("majority_label"))
    return test.join(F.broadcast(best)).groupBy("majority_label").agg(F.avg((F.col(label) == F.col("majority_label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def binary(rows: DataFrame, true: str = "y", predicted: str = "p") -> DataFrame:
    t, p = F.col(true) == 1, F.col(predicted) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = rows.agg(count(t & p).alias("tp"), count(~t & ~p).alias("tn"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    pr, re = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "tp", "tn", "fp", "fn", ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"), pr.alias("precision"), re.alias("recall"), f1(pr, re).alias("f1"),
        ratio(F.col("tp") + F.col("fn"), n).alias("true_rate"), ratio(F.col("tp") + F.col("fp"), n).alias("predicted_rate"),
    )


def multilabel(rows: DataFrame, vocabulary: list[str], true: str = "true_set", predicted: str = "predicted_set") -> DataFrame:
    """Micro and macro F1 over ``vocabulary``, labels without support included, and exact match."""
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    n = lambda t, p, v: F.sum(F.when((has(true, v) if t else ~has(true, v)) & (has(predicted, v) if p else ~has(predicted, v)), 1).otherwise(0))
    each = rows.agg(
        F.array(*[F.struct(n(1, 1, v).alias("tp"), n(0, 1, v).alias("fp"), n(1, 0, v).alias("fn")) for v in vocabulary]).alias("c"),
        F.avg((F.array_sort(F.array_distinct(true)) == F.array_sort(F.array_distinct(predicted))).cast("double")).alias("exact_match"),
    )
    total = lambda k: F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x[k])
    one = lambda x: ratio(2.0 * x["tp"], 2.0 * x["tp"] + x["fp"] + x["fn"])
    return each.select(
        ratio(2.0 * total("tp"), 2.0 * total("tp") + total("fp") + total("fn")).alias("micro_f1"),
        (F.aggregate("c", F.lit(0.0), lambda a, x: a + one(x)) / len(vocabulary)).alias("macro_f1"),
        "exact_match",
    )


def regression(rows: DataFrame, pairs: list[tuple[str, str]], floor: float | None = None) -> DataFrame:
    """mse, mae and r2 over all (true, predicted) columns; r2's total is about each column's own
    mean and comes with the rest from one pass of sums. A total of 0 gives r2 0, or with
    ``floor`` the total is at least that."""
    error = [F.col(t) - F.col(p) for t, p in pairs]
    sums = rows.agg(
        F.count("*").alias("n"),
        sum((F.sum(e * e) for e in error), F.lit(0.0)).alias("sse"),
        sum((F.sum(F.abs(e)) for e in error), F.lit(0.0)).alias("sae"),
        sum((F.var_pop(t) * F.count(t) for t, _ in pairs), F.lit(0.0)).alias("sst"),
    )
    n = F.col("n") * len(pairs)
    r2 = 1 - F.col("sse") / F.greatest(F.col("sst"), F.lit(floor)) if floor else F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(0.0)
    return sums.select((F.col("sse") / n).alias("mse"), (F.col("sae") / n).alias("mae"), r2.alias("r2"))


def joint_error(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """Mean distance between arrays of points, over all points and over the last of each row."""
    gap = F.zip_with(true, predicted, lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))
    each = rows.select(F.explode(gap).alias("g"), F.element_at(gap, -1).alias("last"), F.size(gap).alias("k"))
    return each.agg(F.avg("g").alias("mpjpe"), (F.sum(F.col("last") / F.col("k")) / F.sum(1.0 / F.col("k"))).alias("final_mpjpe"))


def field_accuracy(rows: DataFrame, fields: dict[str, tuple[str, str]], empty: float | None = None) -> DataFrame:
    """Share of equal answers by field where the truth is not "unknown"; ``empty`` if none is."""
    known = lambda t: F.col(t) != "unknown"
    return rows.agg(*[
        F.coalesce(F.avg(F.when(known(t), (F.col(t) == F.coalesce(p, F.lit(""))).cast("double"))), F.lit(empty).cast("double")).alias(name) for name, (t, p) in fields.items()
    ])


def set_f1(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """Micro F1 over sets; null if both sides are empty throughout."""
    sizes = rows.agg(
        F.sum(F.size(F.array_intersect(true, predicted))).alias("tp"), F.sum(F.size(F.array_distinct(true))).alias("t"), F.sum(F.size(F.array_distinct(predicted))).alias("p")
    )
    return sizes.select(ratio(2.0 * F.col("tp"), F.col("t") + F.col("p"), None).alias("object_micro_f1"))


def seen_accuracy(rows: DataFrame, train_labels: DataFrame) -> DataFrame:
    """Accuracy of (true_label, predicted_label) by whether the true label is in ``train_labels``."""
    known = train_labels.select(F.col("label").alias("_l")).where("_l is not null").distinct().withColumn("_s", F.lit(1))
    joined = rows.join(known, rows["true_label"] == known["_l"], "left")
    return joined.groupBy(F.col("_s").isNotNull().alias("seen")).agg(F.count("*").alias("n"), F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("accuracy"))


def folded_match(true: Column, predicted: Column) -> Column:
    """Equal but for case and outer blanks; an empty prediction never matches."""
    fold = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (fold(true) == fold(predicted)) & (fold(predicted) != "")


def signed_delta(base: Column, variant: Column, higher_is_better: Column, tie: float = 1e-9) -> dict[str, Column]:
    """The gain of a variant (positive is better), relative to the base, and its verdict."""
    gain = F.when(higher_is_better, variant - base).otherwise(base - variant)
    return {"gain": gain, "relative_gain": ratio(gain, F.abs(base), None), "verdict": F.when(F.abs(gain) <= tie, "tie").when(gain > 0, "better").otherwise("worse")}


def error_score(error: Column) -> Column:
    """An error turned into a score in (0, 1]."""
    return 1 / (1 + error)


def _free(links: list[int], at: int) -> int:
    """The nearest place from ``at`` on, along ``links``, that links to itself; the way is shortened."""
    while links[at] != at:
        links[at] = links[links[at]]
        at = links[at]
    return at


def _match(places: list[int], guesses: list[int], tolerance: int) -> tuple[int, int, int, float]:
    """Sizes, matches and sum of gaps of a piece, both lists in order. Taken boundaries link to their
    neighbours, so the nearest free one on either side of a prediction is found without passing over
    all of them."""
    from bisect import bisect_left

    n, matched, gap_sum = len(places), 0, 0
    below, above = list(range(n + 1)), list(range(n + 1))  # below is shifted by one, 0 is none
    for guess in guesses:
        at = bisect_left(places, guess)
        left, right = _free(below, at) - 1, _free(above, at)
        choices = [(abs(places[k] - guess), k) for k in (left, right) if 0 <= k < n]
        gap, k = min(choices, default=(tolerance + 1, -1))
        if gap <= tolerance:
            below[k + 1], above[k] = k, k + 1
            matched, gap_sum = matched + 1, gap_sum + gap
    return n, len(guesses), matched, float(gap_sum)


def _matcher(tolerance: int):
    def match(batches):
        """A row a piece of rows sorted by (episode_id, piece, frame_idx); a piece may span batches."""
        import pyarrow as pa

        names, at, held, kind = ["episode_id", "true", "predicted", "matched", "gap_sum"], None, ([], []), None
        for batch in batches:
            kind, done = batch.schema.field("episode_id").type, []
            for episode, piece, frame, is_true in zip(*(batch.column(c).to_pylist() for c in ("episode_id", "piece", "frame_idx", "is_true")), strict=True):
                if at != (episode, piece):
                    if at is not None:
                        done.append((at[0], *_match(*held, tolerance)))
                    at, held = (episode, piece), ([], [])
                held[0 if is_true else 1].append(frame)
            yield _rows(pa, names, kind, done)
        if at is not None:
            yield _rows(pa, names, kind, [(at[0], *_match(*held, tolerance))])

    return match


def _rows(pa, names, kind, rows):
    types = (kind, pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def boundary_matches(truth: DataFrame, predicted: DataFrame, tolerance: int = 10) -> DataFrame:
    """Per episode the one-to-one matches of predicted to true boundaries (episode_id, frame_idx):
    predictions in order each take the nearest free true one, the earlier on a tie.

    What is free depends on the choices before only within reach: an episode is cut wherever no
    boundary of either kind follows within ``tolerance`` frames, the cuts are found by scans over
    ranges, and each piece is matched by itself; a task reads its pieces as one sorted stream, as there
    are too many for a frame each. (A stretch without any such gap stays one piece.)
    """
    both = truth.select("episode_id", "frame_idx", F.lit(True).alias("is_true")).unionByName(predicted.select("episode_id", "frame_idx", F.lit(False).alias("is_true")))
    kind = truth.schema["episode_id"].dataType.simpleString()
    frames = both.select("episode_id", "frame_idx").distinct()
    ended = (F.coalesce(F.col("_next") - F.col("frame_idx"), F.lit(tolerance + 1)) > tolerance).cast("int")
    marked = scans.carry(frames, ["episode_id"], ["frame_idx"], following={"_next": "frame_idx"}).withColumn("_end", ended)
    numbered = scans.running(marked.drop("_next"), ["episode_id"], ["frame_idx"], {"_ends": F.col("_end")})
    pieces = numbered.select(F.col("episode_id").alias("_e"), F.col("frame_idx").alias("_f"), (F.col("_ends") - F.col("_end")).alias("piece"))
    met = both.join(pieces, both["episode_id"].eqNullSafe(pieces["_e"]) & (both["frame_idx"] == pieces["_f"])).select("episode_id", "piece", "frame_idx", "is_true")
    laid = met.repartition("episode_id", "piece").sortWithinPartitions("episode_id", "piece", "frame_idx")
    found = laid.mapInArrow(_matcher(tolerance), f"episode_id {kind}, true long, predicted long, matched long, gap_sum double")
    return found.groupBy("episode_id").agg(*[F.sum(c).alias(c) for c in ("true", "predicted", "matched", "gap_sum")])


def boundary_f1(matches: DataFrame) -> DataFrame:
    total = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("true", "predicted", "matched", "gap_sum")])
    p, r = ratio(F.col("matched"), F.col("predicted")), ratio(F.col("matched"), F.col("true"))
    return total.select(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), ratio(F.col("gap_sum"), F.col("matched"), None).alias("mean_gap"))
