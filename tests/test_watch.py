"""A watched log: runs that complete, fail and go silent."""

import json
import time

import pytest

from windlass.streaming import progress


def say(folder, name, *events):
    lines = [json.dumps({"run_id": r, "event": e, "timestamp": time.time(), "global_step": s, "total_steps": 10, "loss": 1.0}) for r, e, s in events]
    (folder / f".{name}.tmp").write_text("\n".join(lines))
    (folder / f".{name}.tmp").rename(folder / f"{name}.json")


@pytest.fixture
def folder(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "log").mkdir()
    yield tmp_path / "log"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_complete_fail_and_go_stale(spark, folder, tmp_path):
    say(folder, "a", ("one", "step", 3), ("one", "complete", 10), ("two", "step", 1), ("two", "step", 4), (None, "step", 1))
    log = progress.read_log(spark, str(folder))
    done = progress.wait_for(log, ["one"], str(tmp_path / "c1"), 60, 30)
    assert done["one"]["state"] == "complete" and done["one"]["last_step"] == 10
    with pytest.raises(progress.RunStale, match="two"):
        progress.wait_for(log, ["one", "two"], str(tmp_path / "c2"), 90, 2)
    with pytest.raises(TimeoutError, match="three"):
        progress.wait_for(log, ["three"], str(tmp_path / "c3"), 6, 60)
    say(folder, "b", ("two", "failed", None))
    with pytest.raises(progress.RunFailed, match="two"):  # goes on where the watch before ended
        progress.wait_for(log, ["two"], str(tmp_path / "c2"), 60, 60)
