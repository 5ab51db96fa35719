"""Operators that once put a whole group or column into one task."""

import random

import numpy as np
from pyspark.sql import functions as F

from windlass.operators import retrieval, selection


def test_packing_and_quantiles_are_dealt_out(spark):
    rng = random.Random(2)
    rows = [("hot" if k % 3 else f"s{k % 7}", k, rng.randint(0, 40)) for k in rng.sample(range(3000), 3000)]
    packed = selection.pack_batches(spark.createDataFrame(rows, "session string, at long, bytes long"), "session", "at", 100, 5)
    want, state = {}, {}
    for group, at, b in sorted(rows):
        batch, size, items = state.get(group, (0, 0, 0))
        if items and (size + b > 100 or items >= 5):
            batch, size, items = batch + 1, 0, 0
        state[group] = (batch, size + b, items + 1)
        want[group, at, b] = batch
    assert {(r.session, r.at, r.bytes): r.batch for r in packed.collect()} == want
    plan = packed._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "hashpartitioning(session" not in plan  # no task holds a group
    null = spark.createDataFrame([(None, 1, 60), (None, 2, None), (None, 3, 50), (None, None, 7), ("a", 1, 500), ("a", 2, 1)], "session string, at long, bytes long")
    found = sorted(tuple(map(str, r)) for r in selection.pack_batches(null, "session", "at", 100, 5).collect())
    assert found == sorted([("None", "1", "60", "0"), ("None", "2", "None", "0"), ("None", "3", "50", "1"), ("None", "None", "7", "1"), ("a", "1", "500", "0"), ("a", "2", "1", "1")])
    assert selection.pack_batches(null.limit(0), "session", "at", 100, 5).count() == 0

    values = [rng.randint(0, 5000) for _ in range(4001)]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = selection.index_quantiles(frame, "v")
        row, plan = found.first(), found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(values)
    n = len(order)
    assert tuple(row) == (order[n // 4], order[n // 2], order[3 * n // 4], order[-1])
    assert "windowspecdefinition(v#" not in plan  # no window over all values
    assert tuple(selection.index_quantiles(frame.where(F.lit(False)), "v").first()) == (None,) * 4


def test_ranking_takes_queries_in_blocks(spark, monkeypatch):
    """Several blocks of both sides, and no collect of the queries."""
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "MAX_QUERY_BYTES", 8, raising=False)  # the cap that refused more queries
    x = np.random.default_rng(4).standard_normal((90, 6))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    queries = frame.where("id < 40").withColumn("target", (F.col("id") + 7) % 90)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    got = {r.id: r.rank for r in retrieval.ranks(queries, frame).collect()}
    assert got == {k: 1 + int((cos[k] > cos[k, k + 7] + 1e-12).sum()) for k in range(40)}
    top = {(r.id, r.place): r.candidate for r in retrieval.top_k(queries, frame, 5).collect()}
    want = {(k, j + 1): int(c) for k in range(40) for j, c in enumerate([c for c in np.argsort(-cos[k]) if c != k][:5])}
    assert top == want
