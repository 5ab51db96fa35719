"""Perceptron heads: layer norm, two hidden GELU layers and a linear one, trained by AdamW.

Rows are dealt to learners of a bounded size, each the rows of one task. A round is an epoch of
mini-batches in every learner from the same weights; weights and moments are then averaged by
rows, in a tree. One learner, as for small tables, is plain mini-batch training.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.functions.lineage import cut
from windlass.operators import blocks
from windlass.operators.descent import MOST_POSITIVE, hot, sigmoid, softmax

#: Numbers that a learner holds at most.
LEARNER = 1 << 24
BETAS, TINY = (0.9, 0.999), 1e-8


@dataclass
class Settings:
    hidden: int = 64
    epochs: int = 20
    batch: int = 128
    rate: float = 1e-3
    decay: float = 1e-2
    dropout: float = 0.1
    seed: int = 7


@dataclass
class Perceptron:
    """Its arrays, in the order of ``start``, the scales of features and targets, and its course."""

    arrays: list
    x_mean: object
    x_deviation: object
    y_mean: object = 0.0
    y_deviation: object = 1.0
    history: list[dict] = field(default_factory=list)

    def output(self, x):
        return forward(self.arrays, (x - self.x_mean) / self.x_deviation)[0]


def start(features: int, outputs: int, settings: Settings) -> list:
    """Gain and shift of the norm; weights and bias of each layer, uniform by their inputs."""
    import numpy as np

    rng, sizes = np.random.default_rng(settings.seed), [features, settings.hidden, settings.hidden, outputs]
    arrays = [np.ones(features), np.zeros(features)]
    for a, b in zip(sizes, sizes[1:], strict=False):
        arrays += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return arrays


def _normal(x):
    """The normal distribution and its density; its error is under 1e-7."""
    import numpy as np

    t = 1 / (1 + 0.3275911 * np.abs(x) / np.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x / 2)
    return np.where(x >= 0, 1 - tail / 2, tail / 2), np.exp(-x * x / 2) / np.sqrt(2 * np.pi)


def forward(arrays: list, x, rng=None, dropout: float = 0.0):
    """(output, what ``backward`` needs); with ``rng``, hidden values are dropped."""
    import numpy as np

    gain, shift, *layers = arrays
    centred = x - x.mean(axis=1, keepdims=True)
    normed = centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5)
    value, kept = normed * gain + shift, []
    for k in range(0, 4, 2):
        z = value @ layers[k] + layers[k + 1]
        share, density = _normal(z)
        mask = (rng.random(z.shape) >= dropout) / (1 - dropout) if rng is not None and dropout else 1.0
        kept.append((value, (share + z * density) * mask))
        value = z * share * mask
    return value @ layers[4] + layers[5], (normed, kept, value)


def backward(arrays: list, held, slope) -> list:
    """Gradients of all arrays for the gradient of the output."""
    normed, kept, value = held
    made = [value.T @ slope, slope.sum(axis=0)]
    slope = slope @ arrays[6].T
    for k, (below, factor) in ((1, kept[1]), (0, kept[0])):
        slope = slope * factor
        made = [below.T @ slope, slope.sum(axis=0), *made]
        slope = slope @ arrays[2 + 2 * k].T
    return [(slope * normed).sum(axis=0), slope.sum(axis=0), *made]


def _epoch(arrays: list, moments: list, x, y, loss: Callable, settings: Settings, epoch: int, learner: int):
    """One pass over the rows in mini-batches: (arrays, moments, summed loss)."""
    import numpy as np

    rng = np.random.default_rng([settings.seed, epoch, learner])
    arrays, first, second = [a.copy() for a in arrays], [m.copy() for m in moments[0]], [m.copy() for m in moments[1]]
    order, total, done = rng.permutation(len(x)), 0.0, int(moments[2])
    for at in range(0, len(x), settings.batch):
        own = order[at : at + settings.batch]
        out, held = forward(arrays, x[own], rng, settings.dropout)
        value, slope = loss(out, y[own])
        total, done = total + value * len(own), done + 1
        for k, g in enumerate(backward(arrays, held, slope)):
            first[k] = BETAS[0] * first[k] + (1 - BETAS[0]) * g
            second[k] = BETAS[1] * second[k] + (1 - BETAS[1]) * g * g
            arrays[k] = arrays[k] * (1 - settings.rate * settings.decay)
            arrays[k] -= settings.rate * (first[k] / (1 - BETAS[0] ** done)) / (np.sqrt(second[k] / (1 - BETAS[1] ** done)) + TINY)
    return arrays, [first, second, done], total


def _dealt(rows: DataFrame, x: str | Column, y: str | Column) -> blocks.Packed:
    """Packed rows, the rows of a learner in a task, in an order that their values decide."""
    both = blocks.vectors(rows, x, y)
    said = both.agg(F.count("*"), F.max(F.size("x") + F.size("y"))).first()
    learners = max(1, -(-said[0] * (said[1] or 0) // LEARNER))
    keyed = both.withColumn("_h", F.xxhash64("x", "y")).repartition(learners, F.pmod("_h", F.lit(learners))).sortWithinPartitions("_h", "x", "y")
    return blocks.measured(cut(keyed.select("x", "y").mapInArrow(blocks.pack, blocks.PACKED)))


def _train(held: blocks.Packed, outputs: int, loss: Callable, settings: Settings, targets=None) -> Perceptron:
    import numpy as np

    (x_mean, x_deviation), (y_mean, y_deviation) = blocks.scaler(held)
    arrays, history = start(held.p, outputs, settings), []
    zero = [np.zeros_like(a) for a in arrays]
    moments = [zero, zero, np.zeros(1)]
    for epoch in range(1, settings.epochs + 1):

        def learn(task: int, found, now=(arrays, moments), epoch=epoch):
            parts = list(found)
            if not parts:
                return None
            x, y = (np.concatenate(m) for m in zip(*parts, strict=True))
            x = (x - x_mean) / x_deviation
            y = (y - y_mean) / y_deviation if targets else y
            made, (first, second, done), total = _epoch(*now, x, y, loss, settings, epoch, task)
            return [a * len(x) for a in (*made, *first, *second, np.full(1, float(done)))] + [np.full(1, total)]

        sums = blocks.gathered(held, learn)
        n = len(arrays)
        mean = [a / held.rows for a in sums[:-1]]
        arrays, moments = mean[:n], [mean[n : 2 * n], mean[2 * n : 3 * n], np.ceil(mean[3 * n])]
        if epoch in (1, settings.epochs) or epoch % max(1, settings.epochs // 5) == 0:
            history.append({"epoch": epoch, "loss": float(sums[-1][0] / held.rows)})
    return Perceptron(arrays, x_mean, x_deviation, *((y_mean, y_deviation) if targets else ()), history=history)


def fit_classifier(train: DataFrame, label: str = "label", vector: str = "vector", classes: int | None = None, settings: Settings | None = None) -> Perceptron:
    """Cross entropy, classes weighed by their rarity (mean 1), a batch's loss over its weights."""
    import numpy as np

    settings = settings or Settings()
    held = _dealt(train, vector, F.array(label))
    if not held.rows:
        raise ValueError("no train rows")
    if classes is None:
        classes = int(train.agg(F.max(label)).first()[0]) + 1
    counts = blocks.summed(held, lambda x, y: [np.bincount(y[:, 0].astype(int), minlength=classes).astype(float)])[0]
    weight = counts.sum() / np.maximum(counts, 1.0) / classes
    weight /= max(weight.mean(), 1e-6)

    def loss(out, y):
        code, p = y[:, 0].astype(int), softmax(out)
        own, here = weight[code] / weight[code].sum(), np.arange(len(code))
        value = -(own * np.log(np.maximum(p[here, code], 1e-30))).sum()
        p[here, code] -= 1
        return value, p * own[:, None]

    return _train(held, classes, loss, settings)


def fit_multilabel(train: DataFrame, labels: list[str], true: str = "true_set", vector: str = "vector", settings: Settings | None = None) -> Perceptron:
    """Binary cross entropy of each label, positives weighed by rarity, from 1 to MOST_POSITIVE."""
    import numpy as np

    settings = settings or Settings()
    held = _dealt(train, vector, hot(true, labels))
    if not held.rows:
        raise ValueError("no train rows")
    counts = blocks.summed(held, lambda x, y: [y.sum(axis=0)])[0]
    positive = np.clip((held.rows - counts) / np.maximum(counts, 1.0), 1.0, MOST_POSITIVE)

    def loss(out, y):
        p, weight = sigmoid(out), np.where(y > 0, positive, 1.0)
        value = -(weight * np.log(np.maximum(np.where(y > 0, p, 1 - p), 1e-30))).mean()
        return value, (p - y) * weight / y.size

    return _train(held, len(labels), loss, settings)


def fit_regressor(train: DataFrame, x: str = "x", y: str = "y", settings: Settings | None = None) -> Perceptron:
    """Mean squared error of standardised targets."""
    held = _dealt(train, x, y)
    if not held.rows:
        raise ValueError("no train rows")
    return _train(held, held.q, lambda out, y: (((out - y) ** 2).mean(), 2 * (out - y) / y.size), settings or Settings(), targets=True)


def class_scores(model: Perceptron, test: DataFrame, vector: str = "vector") -> DataFrame:
    """``test`` with predicted (a class code) and confidence."""

    def predict(x):
        p = softmax(model.output(x))
        return p.argmax(axis=1).astype("int32"), p.max(axis=1)

    return blocks.mapped(test, vector, predict, "predicted int, confidence double")


def label_scores(model: Perceptron, test: DataFrame, labels: list[str], vector: str = "vector", threshold: float = 0.5) -> DataFrame:
    """``test`` with predicted_set, the labels at ``threshold`` or more."""
    return blocks.mapped(test, vector, lambda x: [[[w for w, p in zip(labels, r, strict=True) if p >= threshold] for r in sigmoid(model.output(x))]], "predicted_set array<string>")


def value_scores(model: Perceptron, test: DataFrame, x: str = "x") -> DataFrame:
    """``test`` with predicted, an array of all targets."""
    return blocks.mapped(test, x, lambda m: [list(model.output(m) * model.y_deviation + model.y_mean)], "predicted array<double>")


def mlp_predict(train: DataFrame, test: DataFrame, hidden: int = 32, label: str = "label", vector: str = "vector", seed: int = 7, epochs: int = 60) -> DataFrame:
    """Classify ``test``, which gains predicted."""
    return class_scores(fit_classifier(train, label, vector, settings=Settings(hidden, epochs, batch=32, rate=1e-2, seed=seed)), test, vector).drop("confidence")
