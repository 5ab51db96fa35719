"""Operators on small hand-made tables: the edge cases of the data model, and what no SQL covers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlass.functions import geometry, text
from windlass.operators import features, heads, joins, metrics, numbering, quality, retrieval, selection, slices, timeline
from windlass.sources import files
from windlass.streaming import progress


def frames(spark, **episodes):
    """Episodes of labels; a dot is a missing one."""
    rows = [(e, k, None if c == "." else c, float(k)) for e, labels in episodes.items() for k, c in enumerate(labels)]
    return spark.createDataFrame(rows, "episode_id string, frame_idx long, label string, signal double")


def test_windows_are_full_ones_only(spark):
    lengths = spark.createDataFrame([("a", 39), ("b", 19), ("c", 20), ("d", 0)], "episode_id string, n long")
    made = timeline.sliding_windows(lengths).orderBy("episode_id", "start_frame").collect()
    assert [(r.episode_id, r.start_frame, r.end_frame) for r in made] == [("a", 0, 19), ("a", 5, 24), ("a", 10, 29), ("a", 15, 34), ("c", 0, 19)]
    assert {r.episode_id: r.n_windows for r in timeline.window_estimate(lengths, 20, 5).collect()} == {"a": 4, "b": 0, "c": 1, "d": 0}
    skipped = timeline.multiscale_windows(lengths, [("s", 20, 10), ("l", 80, 40)]).where("skipped").select("episode_id", "scale_id")
    assert sorted(map(tuple, skipped.collect())) == [("a", "l"), ("b", "l"), ("b", "s"), ("c", "l"), ("d", "l"), ("d", "s")]


def test_majority_takes_the_first_seen_on_a_tie(spark):
    made = timeline.majority_label(frames(spark, e="ABABABABABAB........"), least=0.5).first()
    assert (made.label, made.fraction) == ("A", 0.5)
    made = timeline.majority_label(frames(spark, e="ABABABABABAB........")).first()
    assert (made.label, made.fraction) == (None, 0.5)
    made = timeline.majority_label(frames(spark, e="." * 20)).first()
    assert (made.label, made.fraction) == (None, 0.0)


def test_gaps_are_no_boundaries_but_runs(spark):
    table = frames(spark, e="AA.BBC")
    assert [(r.frame_idx, r.from_label, r.to_label) for r in timeline.boundaries(table).collect()] == [(5, "B", "C")]
    runs = timeline.label_runs(table).orderBy("run_index").collect()
    assert [(r.label, r.start_frame, r.end_frame) for r in runs] == [("A", 0, 1), (None, 2, 2), ("B", 3, 4), ("C", 5, 5)]
    assert [r.progress for r in timeline.run_progress(table).orderBy("frame_idx").collect()] == [0.0, 1.0, 0.0, 0.0, 1.0, 0.0]


def test_next_action_clamps_to_the_last_frame(spark):
    table = frames(spark, e="A" * 24 + "B")
    windows = timeline.sliding_windows(timeline.episode_lengths(table))
    made = timeline.future_label(windows, table).orderBy("window_index").collect()
    assert [(r.target_frame, r.next_label) for r in made] == [(24, "B"), (24, "B")]


@pytest.mark.parametrize(("n", "train"), [(5, 4), (15, 10), (2, 1), (1, 1)])
def test_chronological_split_rounds_half_to_even(spark, n, train):
    rows = spark.range(n).select(F.lit("e").alias("episode_id"), F.col("id").alias("window_index"))
    made = timeline.chronological_split(rows).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in made}.get("train") == train


def test_asof_takes_the_first_at_or_after(spark):
    poses = spark.createDataFrame([("e", 0, 0), ("e", 10, 1)], "k string, at long, pose long")
    queries = spark.createDataFrame([("e", 3), ("e", 0), ("e", 99), ("f", 1)], "k string, at long")
    made = {(r.k, r["at"]): r.pose for r in joins.asof_forward(queries, poses, "k", "at", "pose").collect()}
    assert made == {("e", 3): 1, ("e", 0): 0, ("e", 99): 1, ("f", 1): None}


def test_nearest_window_kinds_and_ties(spark):
    ddl = "episode_id string, window_index long, start_frame long, end_frame long"
    dense = spark.createDataFrame([("e", 0, 0, 19), ("e", 1, 10, 29), ("e", 2, 15, 34), ("e", 3, 200, 219), ("none", 0, 0, 19)], ddl)
    sparse = spark.createDataFrame([("e", 0, 0, 19), ("e", 1, 20, 39), ("e", 2, 5, 34)], ddl)
    made = {r.window_index: (r.source_index, r.kind, r.center_distance, r.overlap_frames) for r in joins.nearest_window(dense, sparse).collect()}
    brute = {}
    for d in dense.where("episode_id = 'e'").collect():
        best = min(
            (abs(s.start_frame + s.end_frame - d.start_frame - d.end_frame) / 2, -max(0, min(d.end_frame, s.end_frame) - max(d.start_frame, s.start_frame) + 1), s.start_frame, s.window_index)
            for s in sparse.collect()
        )
        brute[d.window_index] = (best[3], best[0], -best[1])
    assert {k: (v[0], v[2], v[3]) for k, v in made.items()} == brute
    assert [made[k][1] for k in (0, 1, 3)] == ["exact_sparse_window", "overlap_nearest_sparse_window", "gap_nearest_sparse_window"]


def test_joins_of_coverage_parity_and_leaks(spark):
    samples = spark.createDataFrame([(1,), (2,)], "id long")
    done = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "id long, p string")
    assert {r.id: r.covered for r in joins.coverage(samples, done, "id").collect()} == {1: False, 2: True}
    assert [r.id for r in joins.pending(samples, done, "id").collect()] == [1]
    rows = spark.createDataFrame([("s", "train"), ("s", "test"), ("t", "train")], "session string, split string")
    assert [r.key for r in quality.split_leaks(rows, "session").collect()] == ["s"]
    marked = joins.keep_first(done, "id", ["p"]).orderBy("id", "p").collect()
    assert [r.duplicate for r in marked] == [False, True, False]


def test_macro_f1_readings_differ(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "true_label string, predicted_label string")
    labels = spark.createDataFrame([(x,) for x in "abcd"], "label string")
    seen, listed = metrics.classification(rows).first(), metrics.classification(rows, labels).first()
    f = (2 / 3 + 1) / 2
    assert math.isclose(seen.macro_f1_supported, f, abs_tol=1e-5)
    assert math.isclose(seen.macro_f1_seen, 2 * f / 3, abs_tol=1e-5)
    assert math.isclose(listed.macro_f1_listed, 2 * f / 4, abs_tol=1e-5)


def test_unknown_truth_gives_no_accuracy(spark):
    rows = spark.createDataFrame([("unknown", "a"), ("unknown", "b")], "t string, p string")
    made = metrics.field_accuracy(rows, {"action": ("t", "p")}).first()
    assert made.action is None if hasattr(made, "action") else None in tuple(made)


def test_boundaries_match_once(spark):
    ddl = "episode_id long, frame_idx long"
    truth, guess = spark.createDataFrame([(1, 10), (1, 50)], ddl), spark.createDataFrame([(1, 8), (1, 12), (1, 90)], ddl)
    made = metrics.boundary_f1(metrics.boundary_matches(truth, guess, 10)).first()
    assert (made.precision, made.recall, made.mean_gap) == (1 / 3, 1 / 2, 2.0)


def test_numbering_matches_a_window(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 10 > 3, "hot").when(F.col("id") % 10 > 0, "b").alias("g"), (F.col("id") * 7919 % 500).alias("v"))
    made = numbering.by_order(rows, ["g"], ["v"]).collect()
    assert len(made) == 500
    for g in ("hot", "b", None):
        part = sorted((r.v, r._at, r._n) for r in made if r.g == g)
        assert [x[1] for x in part] == list(range(1, len(part) + 1)) and {x[2] for x in part} == {len(part)}
    down = numbering.by_order(rows, [], [F.desc("v")]).collect()
    assert [r._at for r in sorted(down, key=lambda r: -r.v)] == list(range(1, 501))
    assert numbering.by_order(rows.limit(0), ["g"], ["v"]).count() == 0


def test_splits_partition_and_keep_sizes(spark):
    rows = spark.range(101).select("id", F.when(F.col("id") < 100, "many").otherwise("one").alias("label"))
    made = selection.stratified_split(rows, "label", "id").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in made} == {("many", "test"): 25, ("many", "train"): 75, ("one", "train"): 1}
    three = selection.guarded_split(spark.range(3), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in three} == {"train": 1, "val": 1, "test": 1}
    held = selection.episode_holdout(spark.range(10), "id").where("split = 'test'").collect()
    assert sorted(r.id for r in held) == [8, 9]


def test_balanced_pick_uses_a_session_once(spark):
    rows = spark.createDataFrame([(f"e{k}", s, b, float(k)) for k, (s, b) in enumerate([("s1", "short"), ("s1", "long"), ("s2", "long"), ("s3", "short")])], "episode_id string, session string, size_band string, score double")
    made = selection.balanced_pick(rows, 1).collect()
    assert len({r.session for r in made}) == len(made)


def test_text_functions(spark):
    replies = ['```json\n{"action": "a", "objects": ["Cup", "cup", " "]}\n```', 'So: {"action": "b"} ok', "[1, 2]", "garbage", None]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, r string")
    made = rows.select("k", text.canonical_answer(text.parse_answer(F.col("r"))).alias("a")).orderBy("k").collect()
    assert [r.a.action for r in made] == ["a", "b", "unknown", "unknown", "unknown"]
    assert made[0].a.objects == ["Cup"] and made[1].a.evidence_window.start_frame == 0
    nine = spark.createDataFrame([([*"abcdefghi", "A"],)], "o array<string>").select(text.distinct_folded(F.col("o")).alias("o")).first()
    assert nine.o == list("abcdefgh")
    one = spark.range(1).select(
        text.family(F.lit("walk and pick up"), text.ACTION_FAMILIES, "other").alias("f"), text.present(F.lit(" n/a ")).alias("n"), text.episode_number(F.lit("ep12")).alias("e"),
        text.match_label(F.lit('"cup."'), F.array(F.lit("Cup"), F.lit("CUP"))).alias("m"),
    ).first()
    assert (one.f, one.n, one.e, one.m) == ("locomotion", None, 12, "CUP")


def test_rotations(spark):
    half = math.sqrt(0.5)
    made = spark.range(1).select(geometry.rotation_vector(geometry.q_multiply(F.array(*map(F.lit, (half, 0.0, 0.0, half))), F.array(*map(F.lit, (half, 0.0, 0.0, half))))).alias("r")).first().r
    assert np.allclose(np.abs(made), [0, 0, math.pi])
    poses = spark.createDataFrame([("e", 0, [1.0, 0.0, 0.0, 0.0]), ("e", 1, [-1.0, 0.1, 0.0, 0.0]), ("e", 2, [-1.0, 0.2, 0.0, 0.0])], "episode_id string, frame_number long, quat array<double>")
    signs = [r.quat[0] for r in geometry.continuous_signs(poses).orderBy("frame_number").collect()]
    assert signs == [1.0, 1.0, 1.0]


def test_spectra_find_a_tone(spark):
    tone = np.sin(2 * np.pi * 440 * np.arange(4000) / 8000).tolist()
    made = features.spectral_summary(spark.createDataFrame([(1, tone), (2, [])], "key long, samples array<double>"), 8000.0).orderBy("key").collect()
    assert abs(made[0].centroid - 440) < 15 and abs(made[0].rolloff - 440) < 15 and len(made[1].log_mel) == 16


def blobs(spark, n=90):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(k, k % 3, (rng.standard_normal(4) * 0.3 + 3 * np.eye(4)[k % 3]).tolist()) for k in range(n)], "id long, label int, vector array<double>")


def test_heads_learn(spark):
    rows = blobs(spark)
    train, test = rows.where("id < 60"), rows.where("id >= 60")
    for made in (heads.softmax_predict(train, test), heads.mlp_predict(train, test, 8), heads.ridge_classify(train, test, 3, "vector")):
        assert made.where("label = predicted").count() >= 28
    table = retrieval.centroids(train)
    assert retrieval.centroid_predict(test, table).where("label = predicted").count() >= 28


def test_ridge_matches_dense_algebra(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 3))
    y = x @ rng.standard_normal((3, 2)) + 5
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>")
    made = np.array([r.predicted for r in heads.ridge_predict(rows, rows).collect()])
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean(0)) / y.std(0)
    want = z @ np.linalg.solve(z.T @ z + np.eye(3), z.T @ t) * y.std(0) + y.mean(0)
    assert np.allclose(np.sort(made, axis=0), np.sort(want, axis=0), atol=1e-6)


def test_multilabel_head_forces_a_label(spark):
    rows = blobs(spark).select("id", "vector", F.array(F.concat(F.lit("l"), F.col("label").cast("string"))).alias("true_set"))
    made = heads.multilabel_predict(rows, rows, ["l0", "l1", "l2", "never"]).collect()
    assert all(r.predicted_set for r in made) and sum(r.predicted_set == r.true_set for r in made) > 80
    prior = heads.prior_predict(rows, rows).first()
    assert prior.predicted_set == ["l0", "l1", "l2"]


def test_retrieval_ranks_match_numpy(spark):
    rows = blobs(spark, 30)
    made = retrieval.top_k(rows, rows, 3).collect()
    v = np.array([r.vector for r in rows.orderBy("id").collect()])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T - 9 * np.eye(30)
    for r in made:
        assert np.isclose(cos[r.id, r.candidate], np.sort(cos[r.id])[::-1][r.place - 1], atol=1e-5)


def test_quality_checks(spark):
    rows = spark.createDataFrame([("a", None), ("a", " "), ("b", "x /home/me/y")], "id string, t string")
    assert [r.key for r in quality.duplicate_ids(rows, "id").collect()] == ["a"]
    assert quality.missing_fields(rows, "id", ["t"]).count() == 2
    assert [r.detail for r in quality.forbidden_text(rows, "id", "t").collect()] == ["local_path"]
    pages = spark.createDataFrame([("p", '<a href="q#top"></a><a href="gone"></a><i id="x"></i><i id="x"></i>')], "page_id string, html string")
    links = quality.page_links(pages)
    found = quality.broken_links(links, spark.createDataFrame([("q",)], "path string"), spark.createDataFrame([("q", "bottom")], "path string, id string"))
    assert sorted(r.check for r in found.collect()) == ["dead_anchor", "dead_link"]
    assert quality.repeated_anchors(pages).count() == 1
    gaps = quality.manifest_gaps(spark.createDataFrame([("a", 0, 4), ("b", 5, 9)], "name string, start int, end int"))
    assert [r.key for r in gaps.collect()] == ["b"]
    claims = quality.claims(spark.createDataFrame([(1, "It is state of the art. It is not state of the art.")], "id long, t string"), "id", "t", ["state of the art"])
    assert claims.count() == 1
    odd = [(1, "A. 1 the. 2 the. x.\n\tthe a"), (2, "\u3000the x.\u00a0 b the\u2003"), (3, "caf\u00e9 the\u00e9"), (4, "licen\u017fed"), (5, "l\u0131censed"), (6, "the of\u00e9"), (7, "the y.\x0bthe z"), (8, "the\x01b"), (9, "the\u017f")]
    found = quality.claims(spark.createDataFrame(odd, "id long, t string"), "id", "t", ["the", "licensed"], r"(?i)\b(?:of|and)\b")
    want = [("1", "1 the."), ("1", "2 the."), ("1", "\tthe a"), ("2", "the x.\u00a0 b the"), ("3", "caf\u00e9 the\u00e9"), ("4", "licen\u017fed"), ("7", "the y.\x0bthe z"), ("8", "the"), ("9", "the\u017f")]
    assert sorted((r.key, r.detail) for r in found.collect()) == sorted(want)
    counts = quality.split_counts(spark.createDataFrame([("train",), ("odd",)], "split string"), {"train": 1, "test": 2})
    assert sorted(r.key for r in counts.collect()) == ["odd", "test"]


def test_slices_list_a_row_for_each_member(spark):
    rows = spark.createDataFrame([("e1", ["a", "b"], ["a"], 1), ("e2", ["b"], ["b"], 0)], "episode string, objects array<string>, predicted array<string>, action int")
    made = {(r.slice, r.group): (r.samples, r.action_rate, r.object_f1) for r in slices.error_slices(rows, ["episode", "objects"], ["action"], ("objects", "predicted")).collect()}
    assert made[("objects", "b")] == (2, 0.5, 0.8) and made[("episode", "e2")] == (1, 0.0, 1.0)


def test_readers_and_writers(spark, tmp_path):
    path = f"{tmp_path}/rows.jsonl"
    with open(path, "w") as f:
        f.write('{"id": "a", "n": 1}\n\n{broken\n{"id": "b", "n": 2}\n')
    assert files.read_jsonl(spark, path, "id string, n int", tolerant=True).count() == 2
    assert files.read_jsonl_kept(spark, path, "id string, n int").cache().where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        files.read_jsonl(spark, path, "id string, n int").collect()
    rows = spark.createDataFrame([(1, "x|y")], "id int, t string")
    files.write_csv(rows, f"{tmp_path}/csv", single=True)
    assert files.read_csv(spark, f"{tmp_path}/csv").first().t == "x|y"
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_csv(rows, f"{tmp_path}/csv")
    files.write_jsonl(rows, f"{tmp_path}/log", append=True)
    files.write_jsonl(rows, f"{tmp_path}/log", append=True)
    assert files.read_jsonl(spark, f"{tmp_path}/log", "id int").count() == 2
    assert files.markdown(rows) == "| id | t |\n| --- | --- |\n| 1 | x\\|y |"
    made = [files.cached_features(lambda: rows, f"{tmp_path}/features", spark, width=20).count() for _ in range(2)]
    assert made == [1, 1]
    assert files.list_files(spark, str(tmp_path), "*.jsonl").first().extension == ".jsonl"
    nested = spark.createDataFrame([("/home/me/a", ("/home/me/b",))], "p string, s struct<q: string>")
    assert files.sanitized(nested, {"/home/me": "~"}).first() == ("~/a", ("~/b",))


def test_progress_in_batch_and_stream(spark, tmp_path):
    events = [("r", "step", 10.0, 1, 4, 2.0), ("r", "step", 30.0, 2, 4, 1.0), ("s", "complete", 5.0, None, None, None)]
    log = spark.createDataFrame(events, progress.LOG_SCHEMA)
    made = {r.run_id: r for r in progress.run_summary(log).collect()}
    assert (made["r"].state, made["r"].seconds_left, made["r"].final_loss, made["s"].state) == ("running", 20.0, 1.0, "complete")
    log.write.json(f"{tmp_path}/log")
    query = progress.watch(progress.read_log(spark, f"{tmp_path}/log"), "progress_test", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        assert spark.table("progress_test").count() == 2
    finally:
        query.stop()


def test_event_time_windows(spark):
    rows = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:01:00', 1L, 'a', 1.0D), (timestamp'2024-01-01 00:04:00', 1L, 'a', 2.0D), (timestamp'2024-01-01 12:00:00', 1L, 'a', 3.0D) AS t(ts, user_id, event_type, value)")
    assert sorted((r.n, r.total) for r in progress.event_rates(rows).collect()) == [(1, 3.0), (2, 3.0)]
    assert sorted(r.n for r in progress.sessions(rows).collect()) == [1, 2]
