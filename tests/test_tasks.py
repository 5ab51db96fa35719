"""The task suite: failures are rows and stop nothing; near boundaries without a tolerance."""

from pyspark.sql import functions as F

from windlass.operators import tasks, timeline


def test_a_failed_task_is_a_row(spark):
    rows = spark.createDataFrame([(k, "train" if k < 40 else "test", [float(k % 3), 1.0], "abc"[k % 3]) for k in range(60)], "id long, split string, x array<double>, label string")
    made = tasks.suite(spark, {
        "good": lambda: tasks.classify(rows, epochs=20)[1],
        "empty": lambda: tasks.classify(rows.where("split = 'test'"))[1],
        "broken": lambda: tasks.regress(rows),
        "last": lambda: tasks.decide(rows.withColumn("y", F.col("id") % 2)),
    }).collect()
    by = {}
    for r in made:
        by.setdefault((r.task, r.status), {})[r.metric] = r.value if r.status == "done" else r.error
    assert set(by) == {("good", "done"), ("empty", "failed"), ("broken", "failed"), ("last", "done")}
    assert by["good", "done"]["accuracy"] == 1.0 and by["good", "done"]["num_train"] == 40 and "no train rows" in by["empty", "failed"][None]
    assert tasks.suite(spark, {}).count() == 0


def test_near_boundary_without_tolerance(spark):
    windows = spark.createDataFrame([(1, k, k * 5) for k in range(4)], "episode_id long, window_index long, center_frame long")
    bounds = spark.createDataFrame([(1, 5), (1, 11), (2, 0)], "episode_id long, frame_idx long")
    assert [r.transition for r in timeline.near_boundary(windows, bounds, 0).orderBy("window_index").collect()] == [0, 1, 0, 0]
    assert [r.transition for r in timeline.near_boundary(windows, bounds, 1).orderBy("window_index").collect()] == [0, 1, 1, 0]
