"""Matching, quantiles, blocks of centroids and hashed bags against plain Python."""

import random

import numpy as np

from windlass.operators import features, heads, metrics, numbering, retrieval, ridge, rollups


def naive_matches(truth, guesses, tolerance):
    """Every prediction in order takes the nearest true frame that no earlier one has."""
    free, total = sorted(truth), []
    for g in sorted(guesses):
        near = [x for x in free if abs(x - g) <= tolerance]
        if near:
            x = min(near, key=lambda v: abs(v - g))
            free.remove(x)
            total.append(abs(x - g))
    return len(total), sum(total)


def test_boundary_matches(spark):
    rng = random.Random(1)
    truth = {e: sorted(rng.sample(range(300), rng.choice((0, 1, 20, 120)))) for e in range(12)}
    guess = {e: sorted(rng.sample(range(300), rng.choice((0, 3, 40, 150)))) for e in range(12)}
    rows = lambda x: spark.createDataFrame([(e, f) for e, fs in x.items() for f in fs], "episode_id int, frame_idx long")
    for tolerance in (0, 4, 30):
        found = {r.episode_id: (r.true, r.predicted, r.matched, r.gap_sum) for r in metrics.boundary_matches(rows(truth), rows(guess), tolerance).collect()}
        want = {e: (len(truth[e]), len(guess[e]), *naive_matches(truth[e], guess[e], tolerance)) for e in truth if truth[e] or guess[e]}
        assert found == want
    assert "InPandas" not in metrics.boundary_matches(rows(truth), rows(guess), 4)._jdf.queryExecution().toString()  # no frame a piece


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 40, 501).tolist(), [7], [1, 2], rng.integers(0, 10**9, 300).tolist()):
        got = numbering.quantiles(spark.createDataFrame([(v,) for v in [*values, None]], "v long"), "v", {"a": 0.05, "b": 0.5, "c": 0.75, "d": 1.0}).first()
        assert np.allclose(list(got), np.percentile(values, [5, 50, 75, 100]))
    none = numbering.quantiles(spark.createDataFrame([], "v long"), "v", {"a": 0.5}).first()
    assert list(none) == [None]


def test_centroids_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, f"c{k % 9}", rng.standard_normal(5).tolist()) for k in range(200)], "id long, label string, vector array<double>")
    table = retrieval.centroids(rows)
    whole = {r.id: r.predicted for r in retrieval.centroid_predict(rows, table).collect()}
    monkeypatch.setattr(retrieval, "MAX_TABLE", 0)
    monkeypatch.setattr(retrieval, "BLOCK", 30)
    assert {r.id: r.predicted for r in retrieval.centroid_predict(rows, table).collect()} == whole


def test_image_edges_and_log_mel(spark):
    rng = np.random.default_rng(4)
    image = rng.random((5, 7))
    rows = spark.createDataFrame([(1, x, y, float(image[y, x])) for y in range(5) for x in range(7)] + [(2, 0, 0, 0.5)], "k long, x int, y int, g double")
    found = {r.k: list(r)[1:] for r in features.image_edges(rows, "k", "x", "y", rows["g"], 9).collect()}
    gy, gx = (np.abs(v) for v in np.gradient(image))
    assert np.allclose(found[1], [gx.mean(), gy.mean(), gx.std(), gy.std()]) and found[2] == [0, 0, 0, 0]

    filters = features.mel_triangles(16000.0, 1024, 64)
    assert filters.shape == (64, 513) and np.allclose(filters.sum(axis=1), 1) and (filters >= 0).all()
    assert (np.diff(filters.argmax(axis=1)) >= 0).all()
    wave = np.sin(2 * np.pi * 440 * np.arange(4000) / 16000)
    out = {r.key: np.array(r.embedding) for r in features.log_mel_embedding(spark.createDataFrame([(1, wave.tolist()), (2, []), (3, None), (4, [1.0, float("nan")])], "key long, samples array<double>"), 16000.0).collect()}
    assert {len(v) for v in out.values()} == {588} and not out[2].any() and not out[3].any()
    frames = 1 + (4000 - 1024) // 512
    mel = np.array([np.log1p(filters @ np.abs(np.fft.rfft(wave[512 * k : 512 * k + 1024] * np.hanning(1024))) ** 2) for k in range(frames)])
    assert np.allclose(out[1][:64], mel.mean(axis=0)) and np.allclose(out[1][128:192], mel.min(axis=0)) and np.allclose(out[1][320:384], np.percentile(mel, 50, axis=0))
    assert np.allclose(out[1][576], np.sqrt((wave * wave).mean())) and out[1][587] == frames and np.allclose(out[1][586], 0.25)
    assert abs(filters[int(out[1][:64].argmax())].argmax() * 16000 / 1024 - 440) < 40


def test_wide_ridge_equals_narrow(spark, monkeypatch):
    """More columns than a summed system may have are solved by steps; the solution is the same."""
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((40, 12)), rng.standard_normal((40, 2))
    x[:, 3] = 1.5
    rows = spark.createDataFrame([(k, x[k].tolist(), y[k].tolist()) for k in range(40)], "id long, x array<double>, y array<double>")
    for standardize in (True, False):
        narrow = {r.id: r.predicted for r in heads.ridge_predict(rows.where("id < 30"), rows, alpha=0.7, standardize_y=standardize).collect()}
        monkeypatch.setattr(ridge, "DIRECT", 5)
        monkeypatch.setattr(ridge, "WEIGHTS", 12)
        wide = {r.id: r.predicted for r in heads.ridge_predict(rows.where("id < 30"), rows, alpha=0.7, standardize_y=standardize).collect()}
        monkeypatch.undo()
        assert all(np.allclose(narrow[k], wide[k], atol=1e-8) for k in narrow) and len(wide) == 40


def test_contract_violations(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, None, 0.0), (3, "b", None)], "id long, kind string, size double")
    found = {(r.key, r.detail) for r in rollups.config_violations(rows, "id", ["kind"], ["size"], {"kind": ["a"]}).collect()}
    assert found == {("2", "missing kind"), ("2", "not positive size"), ("2", "unknown kind"), ("3", "not positive size"), ("3", "unknown kind")}
    flat, wrong = rollups.listed_values(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, v array<double>"), "v", {}, 2)
    assert [tuple(r) for r in flat.orderBy("step").collect()] == [(1, 1, 1.0), (1, 2, 2.0)] and {r.id for r in wrong.collect()} == {2, 3}
