"""Rollups of file listings to episodes, and filters, bands, splits and samples over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.functions.lineage import landed
from windlass.operators import numbering, scans


def stable_hash(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def stable_float(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of a hash."""
    return F.conv(F.substring(stable_hash(seed, key), 1, 12), 16, 10).cast("double") / float(16**12)


def episode_rollup(files: DataFrame, required: list[str]) -> DataFrame:
    """Files (episode_id, session, name, bytes) to episodes: file counts, total bytes, those apart
    from previews (``.rrd``), those of videos and annotations, and which required names miss."""
    b, name = F.col("bytes"), F.col("name")
    when = lambda c: F.sum(F.when(c, b).otherwise(0)).cast("long")
    return files.groupBy("session", "episode_id").agg(
        F.count("*").alias("file_count"), F.sum(b).cast("long").alias("total_bytes"), when(~name.endswith(".rrd")).alias("training_bytes"),
        when(name.endswith(".mp4")).alias("video_bytes"), when(name.startswith("annotation")).alias("annotation_bytes"),
        F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.collect_set("name"))).alias("missing"),
    ).withColumn("complete", F.size("missing") == 0)


def size_distribution(rows: DataFrame, value: str) -> DataFrame:
    """min, p05, p25, p50, p75, p95, max and mean; interpolated, rounded half to even, the mean cut."""
    ends = rows.agg(F.min(value).cast("long").alias("min"), F.max(value).cast("long").alias("max"), F.floor(F.avg(value)).cast("long").alias("mean"))
    shares = {f"p{round(100 * p):02d}": p for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    middle = numbering.quantiles(rows, value, shares).select(*[F.bround(k).cast("long").alias(k) for k in shares])
    return ends.join(F.broadcast(middle)).select("min", *shares, "max", "mean")


def index_quantiles(rows: DataFrame, value: str) -> DataFrame:
    """The values at places n/4, n/2 and 3n/4 of the sorted column (from 0), not interpolated."""
    pick = lambda at: F.min(F.when(F.col("_h") > at, F.col(value)))
    n = F.col("n")
    return numbering.running_counts(rows, value).agg(pick(F.floor(n / 4)).alias("q25"), pick(F.floor(n / 2)).alias("q50"), pick(F.floor(3 * n / 4)).alias("q75"), F.max(value).alias("max"))


def percentile_filter(rows: DataFrame, value: str, p: float = 0.05, floor: float | None = None) -> DataFrame:
    """``rows`` with ``accepted``: value at least its p-quantile, and at least ``floor``."""
    least = numbering.quantiles(rows, value, {"_q": p}).select(F.greatest("_q", F.lit(float(floor or 0))).alias("_q") if floor else "_q")
    return rows.join(F.broadcast(least)).withColumn("accepted", F.col(value) >= F.col("_q")).drop("_q")


def size_band(rows: DataFrame, value: str) -> DataFrame:
    """short, lower_mid, upper_mid or long by the quartiles of ``value``, each cut inclusive."""
    q = numbering.quantiles(rows, value, {f"_q{k}": p for k, p in enumerate((0.25, 0.5, 0.75))})
    v = F.col(value)
    band = F.when(v <= F.col("_q0"), "short").when(v <= F.col("_q1"), "lower_mid").when(v <= F.col("_q2"), "upper_mid").otherwise("long")
    return rows.join(F.broadcast(q)).withColumn("size_band", band).drop("_q0", "_q1", "_q2")


def best_per(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of least score of each group, the least ``tie`` first; found by an aggregate, so that a
    group is combined where its rows are."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[f"`{c}`" for c in rows.columns]), F.struct(score, tie)).alias("_b"))
    return best.select("_b.*")


def hash_split(rows: DataFrame, band: str, key: str, seed: str = "split", train: float = 0.75, val: float = 0.125) -> DataFrame:
    """Splits each band in the order of a stable hash of ``key``."""
    placed = numbering.by_hash(rows, [band], stable_hash(seed, F.col(key)), key)
    cut = lambda f: F.bround(F.col("_n") * f)
    split = F.when(F.col("_at") <= cut(train), "train").when(F.col("_at") <= cut(train + val), "val").otherwise("test")
    return placed.withColumn("split", split).drop("_at", "_n")


def guarded_split(keys: DataFrame, key: str, seed: str = "split", val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Episodes to train, val and test in hash order, one at least in each where there are three."""
    placed = numbering.by_hash(keys, [], stable_hash(seed, F.col(key)), key)
    size = lambda f: F.when(F.col("_n") < 3, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(F.col("_n") * f)))
    split = F.when(F.col("_at") <= size(test), "test").when(F.col("_at") <= size(test) + size(val), "val").otherwise("train")
    return placed.withColumn("split", split).drop("_at", "_n")


def stratified_split(rows: DataFrame, label: str, key: str, fraction: float = 0.25, seed: str = "strata") -> DataFrame:
    """``fraction`` of each class to test, at least one and never all, in hash order; a class of
    one row stays in train."""
    placed, n = numbering.by_hash(rows, [label], stable_hash(seed, F.col(key)), key), F.col("_n")
    k = F.when(n == 1, F.lit(0)).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.bround(n * fraction))))
    return placed.withColumn("split", F.when(F.col("_at") <= k, "test").otherwise("train")).drop("_at", "_n")


def episode_holdout(rows: DataFrame, key: str, fraction: float = 0.2) -> DataFrame:
    """The last ``max(1, round(n * fraction))`` keys in sorted order are test."""
    placed = numbering.by_order(rows.select(key).distinct(), [], [F.desc(key)])
    marked = placed.select(key, F.when(F.col("_at") <= F.greatest(F.lit(1), F.bround(F.col("_n") * fraction)), "test").otherwise("train").alias("split"))
    return rows.join(marked, key)


def round_robin(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """``limit`` rows taken from the groups in turn, in group order: all first rows, then all
    second ones, and so on."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(limit)


def shard_numbers(rows: DataFrame, group: str, order: str, shards: int) -> DataFrame:
    """``shard``: each group's rows dealt in order to ``shards`` workers."""
    return numbering.by_order(rows, [group], [order]).withColumn("shard", F.pmod(F.col("_at") - 1, F.lit(shards)).cast("int")).drop("_at", "_n")


def strided(rows: DataFrame, group: str, order: str, stride: int, offset: int = 0) -> DataFrame:
    return numbering.by_order(rows, [group], [order]).where(F.pmod(F.col("_at") - 1, F.lit(stride)) == offset).drop("_at", "_n")


def balanced_pick(rows: DataFrame, quota: int, band: str = "size_band", session: str = "session", order: tuple[str, ...] = ("score", "episode_id")) -> DataFrame:
    """``quota`` episodes of each band, no session twice over all bands; bands left short are
    filled up from what remains.

    Bands, of which there are a few, take their turn by name: each takes its first rows whose
    session no band before has used. What is short is filled in order over all bands by the best
    row of each session left. Rows are placed over ranges and joined with the sessions used; none
    come to the driver and no quota is refused. ``order`` must tell rows apart.
    """
    best = landed(best_per(rows, [session, band], order[0], order[1]))
    bands = sorted(r[0] for r in best.select(band).distinct().collect())
    first = lambda left, n: landed(numbering.by_order(left, [], list(order)).where(F.col("_at") <= n).drop("_at", "_n"))
    free = lambda left, picked: left.join(picked.select(session), session, "left_anti").select(*rows.columns)
    picked = landed(best.limit(0))
    for b in bands:
        picked = landed(picked.unionByName(first(free(best.where(F.col(band) == b), picked), quota)))
    short = quota * len(bands) - picked.count()
    if short > 0:
        picked = picked.unionByName(first(best_per(free(best, picked), [session], order[0], order[1]), short))
    return picked.select(*rows.columns)


def pack_batches(rows: DataFrame, group: str, order: str, max_bytes: int, max_items: int) -> DataFrame:
    """``batch``: rows (group, order, bytes) of each group in order, a new batch where the next
    would pass either bound; a row that passes it alone is a batch. Null bytes count as 0.

    Where the batch that a row begins would end is the first row whose running sum of bytes passes
    the row's own by the bound, carried back from later rows. Which rows do begin one follows from
    the first of each group by doubling: each round knows the rows twice as many batches ahead. No
    step needs the rows of a group together; the rounds grow with the logarithm of its batches.
    """
    picked = rows.select(group, order, F.col("bytes").cast("long").alias("bytes"))
    place = [F.col(group), F.col(order).asc_nulls_last(), F.col("bytes")]
    numbered = landed(numbering.by_order(picked, [], place).drop("_n").withColumnRenamed("_at", "_i"))
    size = F.coalesce("bytes", F.lit(0).cast("long"))
    summed = scans.running(numbered, [], ["_i"], {"_sum": size}).drop("_at")
    first = numbered.groupBy(group).agg(F.min("_i").alias("_start")).select("_start")
    marked = summed.join(first, summed["_i"] == first["_start"], "left")
    marked = landed(scans.carry(marked, [], ["_i"], following={"_group_end": "_start"}))
    # Thresholds and sums in one order: what follows a threshold is the first row that passes it.
    asked = marked.select((F.col("_sum") - size + max_bytes).alias("at"), F.lit(1).alias("_q"), F.col("_i").alias("_from"), F.lit(None).cast("long").alias("to"))
    held = marked.select(F.col("_sum").alias("at"), F.lit(0).alias("_q"), F.lit(None).cast("long").alias("_from"), F.col("_i").alias("to"))
    passed = scans.carry(asked.unionByName(held), [], ["at", "_q", F.coalesce("to", "_from")], following={"_passed": "to"}).where("_q = 1").select("_from", "_passed")
    end = F.least("_passed", "_group_end", F.col("_i") + max_items)
    jumps = landed(marked.join(passed, marked["_i"] == passed["_from"]).select("_i", F.greatest(end, F.col("_i") + 1).alias("_to")))
    starts = landed(marked.where("_start is not null").select("_i"))
    while True:
        ahead = starts.join(jumps, "_i").select(F.col("_to").alias("_i"))
        more = landed(starts.union(ahead.join(marked.select("_i"), "_i", "left_semi")).distinct())
        if more.count() == starts.count():
            break
        on = jumps.select(F.col("_i").alias("_j"), F.col("_to").alias("_k"))
        starts, jumps = more, landed(jumps.join(on, F.col("_to") == F.col("_j")).select("_i", F.col("_k").alias("_to")))
    begun = marked.join(starts.withColumn("_begins", F.lit(1)), "_i", "left")
    counted = scans.running(begun, [], ["_i"], {"_b_no": F.coalesce("_begins", F.lit(0)).cast("long")}).drop("_at")
    base = scans.carry(counted.withColumn("_v", F.when(F.col("_start").isNotNull(), F.col("_b_no"))), [], ["_i"], {"_base": "_v"})
    return base.select(group, order, "bytes", (F.col("_b_no") - F.col("_base")).alias("batch"))


def nearest_size(rows: DataFrame, value: str, target: float, n: int, tie: str) -> DataFrame:
    return rows.orderBy(F.abs(F.col(value) - target), tie).limit(n)


def encode_first_seen(rows: DataFrame, label: str, order: str, split: str | None = None) -> DataFrame:
    """(label, code): codes by first sight; with ``split``, labels seen in train come first."""
    keys = [F.min(F.when(F.col(split) == "train", 0).otherwise(1))] if split else [F.min(F.lit(0))]
    first = F.min(F.when(F.col(split) == "train", F.col(order))) if split else F.min(order)
    seen = rows.where(F.col(label).isNotNull()).groupBy(label).agg(keys[0].alias("_t"), first.alias("_f"), F.min(order).alias("_o"))
    placed = numbering.by_order(seen, [], ["_t", F.coalesce("_f", "_o")])
    return placed.select(label, (F.col("_at") - 1).cast("long").alias("code"))
