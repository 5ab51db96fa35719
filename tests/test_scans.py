"""Scans by ranges against windows and sorting, with one key that holds all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from windlass.operators import features, joins, scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    held = [(None if k % 50 == 0 else "hot" if k % 9 else f"k{k % 4}", k, rng.choice([None, None, None, rng.randint(0, 99)]), rng.randint(0, 5)) for k in rng.sample(range(2000), 2000)]
    return spark.createDataFrame(held, "key string, at long, v long, n long").repartition(6)


def test_carried_values_equal_windows(rows):
    w = Window.partitionBy("key").orderBy("at")
    want = rows.withColumns({"a": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    made = scans.carry(rows, ["key"], ["at"], {"a": "v"}, {"b": "v"})
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    assert scans.carry(rows.limit(0), ["key"], ["at"], {"a": "v"}).count() == 0
    # A frame that is open to the end costs the square of its rows.
    assert "unboundedfollowing" not in made._jdf.queryExecution().toString().lower()


def test_running_sums_equal_windows(rows):
    w = Window.partitionBy("key").orderBy("at")
    want = rows.withColumns({"total": F.sum("n").over(w), "_at": F.count("*").over(w)})
    made = scans.running(rows, ["key"], ["at"], {"total": F.col("n")})
    assert sorted(map(str, made.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_one_key_is_many_tasks(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    laid = scans.laid(rows.where("key = 'hot'"), ["key"], ["at"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in laid.groupBy("_b").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)


def test_grouped_quantiles_equal_numpy(rows):
    found = {r.key: (r.lo, r.mid, r.top) for r in scans.grouped_quantiles(rows, ["key"], "v", {"lo": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    values = {}
    for r in rows.collect():
        if r.v is not None:
            values.setdefault(r.key, []).append(r.v)
    assert set(found) == set(values) and all(np.allclose(found[k], np.quantile(v, [0.1, 0.5, 1.0])) for k, v in values.items())


def test_as_of_with_ties_and_one_key(spark):
    rng = random.Random(7)
    table = [("a", rng.randint(0, 300), rng.randint(0, 9)) for _ in range(400)] + [("b", 5, 1)]
    asked = [("a", rng.randint(-5, 310)) for _ in range(500)] + [("b", 9), ("c", 1)]
    made = joins.asof_forward(spark.createDataFrame(asked, "key string, at long"), spark.createDataFrame(table, "key string, at long, value long"), "key", "at", "value")
    last = lambda k: max(((t, v) for key, t, v in table if key == k), default=(None, None))[1]
    want = sorted((k, t, str(min(((x, v) for key, x, v in table if key == k and x >= t), default=(None, last(k)))[1])) for k, t in asked)
    assert sorted((r.key, r.at, str(r.value)) for r in made.collect()) == want


def test_summaries_of_one_hot_key(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    points = spark.createDataFrame([(None if k < 5 else 1, *map(float, v)) for k, v in enumerate(x)], "key long, x double, y double")
    made = {r.key: r for r in features.cloud_summary(points, "key", ["x", "y"]).collect()}
    assert np.allclose([made[1].x_p10, made[1].y_p50, made[1].y_p90], [np.quantile(x[5:, 0], 0.1), np.quantile(x[5:, 1], 0.5), np.quantile(x[5:, 1], 0.9)], atol=1e-6)
    assert np.isclose(made[None].x_p50, np.median(x[:5, 0]), atol=1e-6)
    depth = features.depth_summary(points, "key", "x", "y").where("key = 1").first()
    assert np.isclose(depth.p90, np.quantile(x[5:, 0][x[5:, 0] > 0], 0.9), atol=1e-6)
