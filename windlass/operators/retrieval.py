"""Ranking queries against all candidates, and heads made of array means.

Queries and candidates are cut into blocks of about a fixed size by hash; each pair of blocks is
scored in a task and sends on one row, or ``k``, per query. No pair of rows is ever written down,
no number of queries is refused, and none comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.lineage import cut
from windlass.operators import numbering

#: Rows of a block of queries or of candidates, on average.
BLOCK = 1024
#: Blocks that a side of shifted ranks has until they are ``WIDEST`` times ``BLOCK`` rows, and rows scored at once.
BLOCKS, WIDEST, ROWS = 12, 8, 256
#: Values of all centroids that a worker may hold.
MAX_TABLE = 1 << 22


def _pairs(queries: DataFrame, candidates: DataFrame):
    """Both sides (id, ...) grouped by block of queries and block of candidates, to be cogrouped."""
    n, m = (max(1, -(-rows.count() // BLOCK)) for rows in (queries, candidates))
    block = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("*", block(n).alias("_q"), every(m).alias("_c"))
    right = candidates.select("id", "vector", every(n).alias("_q"), block(m).alias("_c"))
    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c"))


def _matrix(column):
    import numpy as np

    return np.stack(column.to_numpy()).astype(float)


def _scores(queries, candidates, measure: str):
    """Larger is nearer: cosine with norms of at least 1e-8, the dot product, or the negative squared distance."""
    import numpy as np

    if measure == "cosine":
        unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-8)
        return unit(queries) @ unit(candidates).T
    if measure == "dot":
        return queries @ candidates.T
    out = np.empty((len(queries), len(candidates)))
    for k, q in enumerate(queries):
        out[k] = -((candidates - q) ** 2).sum(axis=1)
    return out


def ranks(queries: DataFrame, candidates: DataFrame, measure: str = "cosine") -> DataFrame:
    """(id, rank, score) for queries (id, vector, target): the place of candidate (id, vector)
    ``target`` among all, by falling score; of equal scores the smaller id comes first."""
    import numpy as np
    import pandas as pd

    schema = "id long, rank long, score double"
    wanted = queries.join(candidates.select(F.col("id").alias("_t"), F.col("vector").alias("_v")), F.col("target") == F.col("_t"))
    wanted = cut(wanted.select("id", "vector", "target", "_v"))

    def count(q, c):
        if not len(q) or not len(c):
            return pd.DataFrame({"id": [], "rank": [], "score": []})
        query, truth, target = _matrix(q["vector"]), _matrix(q["_v"]), q["target"].to_numpy()
        own = np.array([_scores(a[None], b[None], measure)[0, 0] for a, b in zip(query, truth, strict=True)])
        got = _scores(query, _matrix(c["vector"]), measure)
        equal = np.abs(got - own[:, None]) <= 1e-12
        ahead = ((got > own[:, None]) & ~equal | equal & (c["id"].to_numpy()[None] < target[:, None])).sum(axis=1)
        return pd.DataFrame({"id": q["id"].to_numpy(), "rank": ahead, "score": own})

    counted = _pairs(wanted, candidates).applyInPandas(count, schema)
    return counted.groupBy("id").agg((F.sum("rank") + 1).cast("long").alias("rank"), F.max("score").alias("score"))


def summary(ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """mrr, mean and median rank, and the share of ranks within each k."""
    means = ranked.agg(
        F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), F.avg("rank").alias("mean_rank"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"top_{k}") for k in ks]
    )
    return means.join(F.broadcast(numbering.quantiles(ranked, "rank", {"median_rank": 0.5})))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, measure: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """(id, place, candidate, score): the best ``k`` candidates of each query (id, vector). Each
    block keeps its own best ``k``; the best of those are the best of all."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    def best(q, c):
        if not len(q) or not len(c):
            return pd.DataFrame({"id": [], "candidate": [], "score": []})
        ids, cid = q["id"].to_numpy(), c["id"].to_numpy()
        got = _scores(_matrix(q["vector"]), _matrix(c["vector"]), measure)
        if exclude_self:
            got[ids[:, None] == cid[None]] = -np.inf
        order = np.lexsort((np.broadcast_to(cid, got.shape), -got), axis=1)[:, :k]
        score = np.take_along_axis(got, order, axis=1)
        out = pd.DataFrame({"id": np.repeat(ids, order.shape[1]), "candidate": cid[order].ravel(), "score": score.ravel()})
        return out[out["score"] > -np.inf]

    found = _pairs(queries.select("id", "vector"), candidates).applyInPandas(best, "id long, candidate long, score double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "candidate"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("id", "place", "candidate", "score")


def dimension_rows(rows: DataFrame, vector: str = "vector") -> DataFrame:
    return rows.select("*", F.posexplode(vector).alias("dim", "x")).drop(vector)


def centroids(train: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """(label, centroid, prior): the mean of each label's unit vectors."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    unit = train.select(label, F.transform(vector, lambda x: x / F.greatest(norm, F.lit(1e-8))).alias("u"))
    dims = unit.select(label, F.posexplode("u").alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    made = dims.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("d"), F.max("n").alias("n"))
    total = made.agg(F.sum("n").alias("_t"))
    return made.join(F.broadcast(total)).select(label, F.transform("d", lambda x: x["m"]).alias("centroid"), (F.col("n") / F.col("_t")).alias("prior"))


def centroid_predict(rows: DataFrame, table: DataFrame, weight: float = 0.03, label: str = "label", vector: str = "vector") -> DataFrame:
    """``rows`` (id, ...) with predicted: the label whose centroid has the highest cosine plus
    ``weight`` times the log of its prior; the smaller label on a tie. Centroids of up to
    ``MAX_TABLE`` values are folded into one array that every worker holds; beyond, blocks of
    rows meet blocks of centroids, and each block sends on the best of its own."""
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-8))
    unit = cut(table.select(label, F.transform("centroid", lambda x: x / norm(F.col("centroid"))).alias("c"), (weight * F.log("prior")).alias("b")))
    if (unit.agg(F.sum(F.size("c"))).first()[0] or 0) > MAX_TABLE:
        coded = cut(numbering.by_order(unit, [], [label]).select(label, F.col("_at").alias("id"), F.array_append("c", F.col("b")).alias("vector")))
        asked = rows.select("id", F.array_append(F.transform(vector, lambda x: x / norm(F.col(vector))), F.lit(1.0)).alias("vector"))
        best = top_k(asked, coded, 1, "dot", exclude_self=False).select("id", F.col("candidate").alias("_k"))
        named = best.join(coded.select(F.col("id").alias("_k"), F.col(label).alias("predicted")), "_k").drop("_k")
        return rows.join(named, "id", "left")
    packed = unit.agg(F.collect_list(F.struct(label, "c", "b")).alias("_classes"))
    joined = rows.join(F.broadcast(packed)).withColumn("_n", norm(F.col(vector)))
    dot = lambda c: F.aggregate(F.zip_with(c, F.col(vector), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = F.transform("_classes", lambda k: F.struct((-(dot(k["c"]) / F.col("_n") + k["b"])).alias("s"), k[label].alias("l")))
    return joined.withColumn("predicted", F.array_min(scored)["l"]).drop("_classes", "_n")


def mean_delta_forecast(train: DataFrame, test: DataFrame, x: str, y: str) -> DataFrame:
    """``test`` with predicted: x standardised, moved by the mean step of the train pairs and
    scaled as y. Population deviations, 1 where under 1e-6."""
    s = train.agg(F.avg(x).alias("mx"), F.stddev_pop(x).alias("sx"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy"))
    s = s.select("mx", "my", *[F.when(F.col(c) < 1e-6, 1.0).otherwise(F.col(c)).alias(c) for c in ("sx", "sy")])
    # The mean of z(y) - z(x) over the train pairs is 0 by standardisation but for rounding.
    return test.join(F.broadcast(s)).withColumn("predicted", (F.col(x) - F.col("mx")) / F.col("sx") * F.col("sy") + F.col("my")).drop("mx", "my", "sx", "sy")


def _ahead(scores, own, places, at, reached):
    """How many of the candidates (columns of ``scores``, at ``places`` in order) come before each
    row's own of ``own`` scores, which stand at places ``at``: one column a shift, and of each shift
    only the candidates from ``reached[k][0]`` up to ``reached[k][1]`` count.

    A row is sorted once for all shifts; only where scores are within 1e-12 of an own one are the
    places looked at."""
    import numpy as np

    bounds = [np.searchsorted(places, ends) for ends in reached]
    ordered = np.sort(scores, axis=1)
    above, not_below = np.empty(own.shape, dtype=np.int64), np.empty(own.shape, dtype=np.int64)
    for r, row in enumerate(ordered):
        above[r] = len(row) - np.searchsorted(row, own[r] + 1e-12, "right")
        not_below[r] = len(row) - np.searchsorted(row, own[r] - 1e-12, "left")
    for r, k in zip(*np.nonzero(not_below > above), strict=True):
        equal = np.abs(scores[r] - own[r, k]) <= 1e-12
        above[r, k] = ((scores[r] > own[r, k]) & ~equal | equal & (places < at[r, k])).sum()
    for k, (a, b) in enumerate(bounds):
        for beyond in (slice(0, a), slice(b, len(places))):
            out, mine = scores[:, beyond], own[:, k, None]
            equal = np.abs(out - mine) <= 1e-12
            above[:, k] -= ((out > mine) & ~equal | equal & (places[beyond] < at[:, k, None])).sum(axis=1)
    return above


def shifted_ranks(rows: DataFrame, shifts: list[int]) -> DataFrame:
    """(group, shift, place, rank) of ``rows`` (group, place, predicted, vector): the row at ``place``
    is looked for by the prediction made ``shift`` places later, among the rows for which there is
    such a prediction; places run from 0 without gaps in each group. Ranks by cosine; of equal
    scores the earlier place comes first.

    All shifts share one pass: a block of predictions meets a block of rows once, and each
    prediction counts, for every shift, the rows of the block that come before its own. Ranks are
    exact, so the pairs grow with the square of a group. Blocks grow with it up to ``WIDEST`` times
    ``BLOCK`` rows: up to there a row is sent to ``BLOCKS`` of them and no more.
    """
    import numpy as np
    import pandas as pd

    rows = cut(rows.select("group", "place", "predicted", "vector"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("_n"))
    size = F.least(F.lit(WIDEST * BLOCK), F.greatest(F.lit(BLOCK), F.ceil(F.col("_n") / BLOCKS)))
    sized = rows.join(sizes, "group").withColumn("_size", size)
    asked = sized.select("group", F.explode(F.array(*[F.lit(s).cast("long") for s in shifts])).alias("shift"), F.col("place").alias("_from"), "predicted", "_n", "_size")
    asked = asked.withColumn("place", F.col("_from") - F.col("shift")).where("place >= 0 and place < _n")
    own = rows.select("group", "place", F.col("vector").alias("_own"))
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-8))
    dot = F.aggregate(F.zip_with("predicted", "_own", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    truth = asked.join(own, ["group", "place"]).withColumn("score", dot / norm(F.col("predicted")) / norm(F.col("_own")))
    # One score a shift; those without a row in reach are 0 and not sent on.
    scores = F.array(*[F.coalesce(F.max(F.when(F.col("shift") == s, F.col("score"))), F.lit(0.0)) for s in shifts])
    wanted = truth.groupBy("group", "_from", "_n", "_size").agg(F.any_value("predicted").alias("predicted"), scores.alias("own"))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.col("_size")))
    left = wanted.select("*", F.floor(F.col("_from") / F.col("_size")).alias("_q"), F.explode(blocks).alias("_c")).drop("_size")
    right = sized.select("group", "place", "vector", F.explode(blocks).alias("_q"), F.floor(F.col("place") / F.col("_size")).alias("_c"))
    shift = np.array(shifts, dtype=np.int64)

    def count(q, c):
        if not len(q) or not len(c):
            return pd.DataFrame({"group": [], "shift": [], "place": [], "ahead": []})
        c, n, name = c.sort_values("place"), int(q["_n"].iloc[0]), q["group"].iloc[0]
        places, vectors, predicted, own = c["place"].to_numpy(), _matrix(c["vector"]), _matrix(q["predicted"]), _matrix(q["own"])
        at = q["_from"].to_numpy()[:, None] - shift[None]
        reached = [(max(0, -s), min(n, n - s)) for s in shift]
        found = np.concatenate([_ahead(_scores(predicted[k : k + ROWS], vectors, "cosine"), own[k : k + ROWS], places, at[k : k + ROWS], reached) for k in range(0, len(q), ROWS)])
        valid = (at >= 0) & (at < n)
        return pd.DataFrame({"group": name, "shift": np.broadcast_to(shift, at.shape)[valid], "place": at[valid], "ahead": found[valid]})

    kind = rows.schema["group"].dataType.simpleString()
    right = right.toDF("_group", "place", "vector", "_q2", "_c2")  # of the same table: other names
    counted = left.groupBy("group", "_q", "_c").cogroup(right.groupBy("_group", "_q2", "_c2")).applyInPandas(count, f"group {kind}, shift long, place long, ahead long")
    return counted.groupBy("group", "shift", "place").agg((F.sum("ahead") + 1).alias("rank"))


def alignment_stress(ranked: DataFrame) -> DataFrame:
    """By shift of ranks from ``shifted_ranks``: queries, mrr, mean rank, and the shares within 1, 5
    and 10."""
    shares = [F.avg((F.col("rank") <= k).cast("double")).alias(f"top_{k}") for k in (1, 5, 10)]
    return ranked.groupBy("shift").agg(F.count("*").alias("queries"), F.avg(1 / F.col("rank")).alias("mrr"), F.avg("rank").alias("mean_rank"), *shares)


def future_metrics(ranked: DataFrame, best: DataFrame, episodes: DataFrame, width: int, k: int = 5) -> DataFrame:
    """One row of the measures of future retrieval: mrr, recall at ``k``, the share of queries whose
    best candidate is of their own episode, and the mean error, the distance to the true future
    over the root of ``width``. ``ranked`` (id, rank, score = minus the squared distance), ``best``
    (id, place, candidate), ``episodes`` (id, episode)."""
    named = episodes.select(F.col("id").alias("candidate"), F.col("episode").alias("_theirs"))
    same = best.where("place = 1").join(episodes, "id").join(named, "candidate", "left").select("id", F.coalesce(F.col("episode") == F.col("_theirs"), F.lit(False)).cast("double").alias("_same"))
    met = ranked.join(same, "id", "left")
    return met.agg(
        F.count("*").alias("queries"), F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}"),
        F.avg(F.coalesce("_same", F.lit(0.0))).alias("temporal_consistency"), F.avg(F.sqrt(-F.col("score")) / width**0.5).alias("reconstruction_error"),
    )
