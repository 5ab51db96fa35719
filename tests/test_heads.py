"""Fitted heads against dense algebra, gradients and held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlass.operators import blocks, descent, perceptron, ridge


def rows_of(spark, x, **columns):
    names = ", ".join(f"{n} {kind}" for n, (kind, _) in columns.items())
    return spark.createDataFrame([(k, x[k].tolist(), *(v[k] for _, v in columns.values())) for k in range(len(x))], f"id long, vector array<double>, {names}").repartition(5)


def standard(x, train):
    mean, deviation = x[train].mean(axis=0), x[train].std(axis=0)
    return (x - mean) / np.where(deviation < 1e-6, 1.0, deviation)


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("fan", [2, 32])
def test_softmax_descent_equals_dense_steps(spark, monkeypatch, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    monkeypatch.setattr(blocks, "CELLS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)) * [1, 3, 0.1, 10, 0] + 2
    y = np.minimum(rng.integers(0, 5, 90), 3)
    rows, train = rows_of(spark, x, label=("int", y.tolist())), np.arange(90) < 70
    model = descent.fit_softmax(rows.where("id < 70"), epochs=12, rate=0.3, l2=0.01, seed=5)
    z, w, b = standard(x, train)[train], np.random.default_rng(5).normal(0, 0.01, (5, 4)).astype(np.float32).astype(float), np.zeros(4)
    own = (70 / np.maximum(np.bincount(y[train], minlength=4), 1) / 4)[y[train]]
    own = own / own.mean()
    for _ in range(12):
        p = softmax(z @ w + b)
        diff = (p - np.eye(4)[y[train]]) * own[:, None] / 70
        w, b = w - 0.3 * (z.T @ diff + 0.01 * w), b - 0.3 * diff.sum(axis=0)
    assert np.allclose(model.weights, w, atol=1e-10) and np.allclose(model.bias, b, atol=1e-10)
    assert [h["epoch"] for h in model.history] == list(range(1, 13)) and model.history[-1]["loss"] < model.history[0]["loss"]
    nulls = spark.createDataFrame([(1000, None, 0)], rows.schema)
    made = {r.id: r for r in descent.softmax_scores(model, rows.where("id >= 70").unionByName(nulls)).collect()}
    p = softmax(standard(x, train)[70:] @ w + b)
    assert all(made[70 + k].predicted == p[k].argmax() and np.isclose(made[70 + k].confidence, p[k].max()) for k in range(20))
    assert made[1000].predicted is None and len(made) == 21
    with pytest.raises(ValueError):
        descent.fit_softmax(rows.limit(0))


def test_multilabel_descent_equals_dense_steps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4))
    sets = [[name for name, on in (("a", v[0] > 0), ("b", v[1] > 1.3), ("c", True)) if on] for v in x]
    labels = ["a", "b", "c", "never"]
    rows = rows_of(spark, x, true_set=("array<string>", sets))
    model = descent.fit_multilabel(rows, labels, epochs=9, rate=0.4, l2=0.02, seed=2)
    y = np.array([[n in s for n in labels] for s in sets], float)
    z, w, b = standard(x, slice(None)), np.random.default_rng(2).normal(0, 0.01, (4, 4)).astype(np.float32).astype(float), np.zeros(4)
    positive = np.clip((80 - y.sum(axis=0)) / np.maximum(y.sum(axis=0), 1), 1, 20)
    for _ in range(9):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        diff = (p - y) * np.where(y > 0, positive, 1) / 80
        w, b = w - 0.4 * (z.T @ diff + 0.02 * w), b - 0.4 * diff.sum(axis=0)
    assert np.allclose(model.weights, w, atol=1e-10) and np.allclose(model.bias, b, atol=1e-10)
    p = 1 / (1 + np.exp(-(z @ w + b)))
    high = {r.id: r.predicted_set for r in descent.multilabel_scores(model, rows, labels, threshold=0.97).collect()}
    assert all(high[k] == ([labels[j] for j in np.flatnonzero(p[k] >= 0.97)] or [labels[p[k].argmax()]]) for k in range(80))


def test_ridge_steps_solve_blocks_of_targets(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(50, 30)) @ np.diag(0.7 ** np.arange(30)), rng.normal(size=(50, 7))
    rows = rows_of(spark, x, y=("array<double>", y.tolist()))
    direct = ridge.fit_ridge(rows, "vector", "y", 0.3, False)
    monkeypatch.setattr(ridge, "DIRECT", 4)
    monkeypatch.setattr(ridge, "WEIGHTS", 90)
    stepped = ridge.fit_ridge(rows, "vector", "y", 0.3, False)
    z = standard(x, slice(None))
    z1 = np.hstack([z, np.ones((50, 1))])
    want = np.linalg.solve(z1.T @ z1 + 0.3 * np.eye(31), z1.T @ y)
    for made in (direct, stepped):
        assert np.allclose(made.weights, want[:-1], atol=1e-7) and np.allclose(made.bias, want[-1], atol=1e-9)
    assert stepped.steps > 0


def test_ridge_of_thousands_of_columns_and_rows(spark):
    """8,546 columns, 4,200 rows: neither a matrix of columns nor one of rows by rows is made."""
    n, p = 4200, 8546
    value = lambda j: F.sin((F.col("id") + 1) * (j + 1) * F.lit(0.618) + j)
    rows = spark.range(n).repartition(8).select("id", F.transform(F.sequence(F.lit(0), F.lit(p - 1)), value).alias("x"), F.array(F.cos(F.col("id") * 0.5), F.col("id") / 1000).alias("y"))
    model = ridge.fit_ridge(rows, alpha=3000.0)
    i, j = np.arange(n)[:, None], np.arange(p)[None]
    x = np.sin((i + 1) * (j + 1) * 0.618 + j)
    y = np.stack([np.cos(np.arange(n) * 0.5), np.arange(n) / 1000], axis=1)
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean(0)) / y.std(0)
    want = z.T @ np.linalg.solve(z @ z.T + 3000.0 * np.eye(n), t)
    assert np.allclose(model.weights, want, atol=1e-8) and 0 < model.steps < 100


def test_perceptron_gradients():
    rng = np.random.default_rng(1)
    settings = perceptron.Settings(hidden=5, seed=3)
    arrays = [a + 0.1 * rng.normal(size=a.shape) for a in perceptron.start(4, 3, settings)]
    x, y = rng.normal(size=(7, 4)), rng.normal(size=(7, 3))
    loss = lambda: ((perceptron.forward(arrays, x)[0] - y) ** 2).sum()
    out, held = perceptron.forward(arrays, x)
    made = perceptron.backward(arrays, held, 2 * (out - y))
    for a, g in zip(arrays, made, strict=True):
        for place in list(np.ndindex(a.shape))[:12]:
            kept = a[place]
            a[place] = kept + 1e-4
            up = loss()
            a[place] = kept - 1e-4
            down = loss()
            a[place] = kept
            assert np.isclose((up - down) / 2e-4, g[place], rtol=2e-3, atol=2e-3)
    import math

    at = np.linspace(-5, 5, 101)
    assert np.allclose(perceptron._normal(at)[0], [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in at], atol=2e-7)


@pytest.mark.parametrize("learner", [1 << 24, 1200])
def test_perceptrons_learn_what_lines_cannot(spark, monkeypatch, learner):
    """Held-out rows of a ring, a product and two overlapping sets, by one learner and by several."""
    monkeypatch.setattr(perceptron, "LEARNER", learner)
    rng = np.random.default_rng(9)
    x = rng.uniform(-2, 2, (700, 3))
    inside = ((x[:, 0] ** 2 + x[:, 1] ** 2) < 2).astype(int)
    sets = [[n for n, on in (("in", i), ("same", v[0] * v[1] > 0)) if on] for v, i in zip(x, inside, strict=True)]
    values = np.stack([x[:, 0] * x[:, 1] * 3 + 5, np.abs(x[:, 2])], axis=1)
    rows = rows_of(spark, np.hstack([x, x**2]), label=("int", inside.tolist()), true_set=("array<string>", sets), y=("array<double>", values.tolist()))
    train, test = rows.where("id % 5 > 0").cache(), rows.where("id % 5 = 0").cache()
    settings = perceptron.Settings(hidden=24, epochs=30, batch=32, rate=1e-2, dropout=0.0)
    model = perceptron.fit_classifier(train, settings=settings)
    assert perceptron.class_scores(model, test).where("label = predicted").count() >= 125
    assert model.history[-1]["loss"] < model.history[0]["loss"] and [h["epoch"] for h in model.history][0] == 1
    model = perceptron.fit_multilabel(train, ["in", "same"], settings=settings)
    made = perceptron.label_scores(model, test, ["in", "same"]).collect()
    assert np.mean([sorted(r.predicted_set) == sorted(r.true_set) for r in made]) > 0.75
    model = perceptron.fit_regressor(train, "vector", "y", settings=settings)
    made = perceptron.value_scores(model, test, "vector").collect()
    error = np.array([np.subtract(r.predicted, r.y) for r in made])
    assert (error**2).sum() < 0.25 * ((values[::5] - values[::5].mean(axis=0)) ** 2).sum()
    again = perceptron.fit_regressor(train, "vector", "y", settings=settings)
    assert all(np.allclose(a, b) for a, b in zip(model.arrays, again.arrays, strict=True))


def test_shifted_ranks_over_blocks_and_groups(spark, monkeypatch):
    from windlass.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK", 8)
    rng = np.random.default_rng(12)
    groups = {"a": 37, "b": 5}
    p, v = {g: rng.normal(size=(n, 3)) for g, n in groups.items()}, {g: rng.normal(size=(n, 3)) for g, n in groups.items()}
    v["a"][7] = v["a"][3]
    rows = spark.createDataFrame([(g, k, p[g][k].tolist(), v[g][k].tolist()) for g, n in groups.items() for k in range(n)], "group string, place long, predicted array<double>, vector array<double>")
    shifts = [-40, -6, 0, 1, 20]
    made = {(r.group, r.shift, r.place): r.rank for r in retrieval.shifted_ranks(rows, shifts).collect()}
    want = {}
    for g, n in groups.items():
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        cos = unit(p[g]) @ unit(v[g]).T
        for s in shifts:
            valid = [i for i in range(n) if 0 <= i + s < n]
            for i in valid:
                row = cos[i + s]
                want[g, s, i] = 1 + sum(row[j] > row[i] + 1e-12 or (abs(row[j] - row[i]) <= 1e-12 and j < i) for j in valid)
    assert made == want
    # Wider blocks, each row sent to fewer of them.
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    monkeypatch.setattr(retrieval, "BLOCKS", 3)
    monkeypatch.setattr(retrieval, "ROWS", 5)
    sent = retrieval.shifted_ranks(rows, shifts)
    assert {(r.group, r.shift, r.place): r.rank for r in sent.collect()} == want
    by = {r.shift: r for r in retrieval.alignment_stress(retrieval.shifted_ranks(rows, shifts)).collect()}
    assert set(by) == {-6, 0, 1, 20} and by[0].queries == 42


def test_candidates_ahead_are_counted_for_all_shifts_by_one_sort():
    from windlass.operators import retrieval

    rng, n, shifts = np.random.default_rng(5), 60, [-9, -1, 0, 4]
    scores, places, at = rng.integers(0, 9, (20, 24)) / 9, np.arange(30, 54), rng.integers(0, n, (20, 4))
    own = rng.integers(0, 9, (20, 4)) / 9
    reached = [(max(0, -s), min(n, n - s)) for s in shifts]
    reached[3] = (33, 50)
    got = retrieval._ahead(scores, own, places, at, reached)
    for r in range(20):
        for k, (a, b) in enumerate(reached):
            assert got[r, k] == sum(a <= p < b and (s > own[r, k] + 1e-12 or abs(s - own[r, k]) <= 1e-12 and p < at[r, k]) for s, p in zip(scores[r], places, strict=True))
