"""Linear heads by full-batch gradient descent: softmax and multilabel logistic regression.

A step is one pass over the packed rows: each task makes the gradient of its rows as one matrix
over all features and classes, the matrices are added in a tree, and the driver moves the
weights. Features are standardised by their train rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.operators import blocks

EPOCHS, RATE, L2 = 60, 0.5, 1e-3
#: Times of its usual weight that a rare label's positive rows may count.
MOST_POSITIVE = 20.0


@dataclass
class Linear:
    """weights (features x classes), bias, the features' mean and deviation, and the fit's course."""

    weights: object
    bias: object
    mean: object
    deviation: object
    history: list[dict] = field(default_factory=list)

    def logits(self, x):
        return (x - self.mean) / self.deviation @ self.weights + self.bias


def start(features: int, classes: int, seed: int):
    """Weights to start from: normal with a deviation of 0.01, single precision, by seed."""
    import numpy as np

    return np.random.default_rng(seed).normal(0.0, 0.01, size=(features, classes)).astype(np.float32).astype(float)


def softmax(logits):
    import numpy as np

    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sigmoid(logits):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(logits, -40, 40)))


def _reported(epoch: int, epochs: int, times: int) -> bool:
    return epoch in (1, epochs) or epoch % max(1, epochs // times) == 0


def _descend(held: blocks.Packed, classes: int, seed: int, epochs: int, rate: float, l2: float, gradient, report, times: int) -> Linear:
    (mean, deviation), _ = blocks.scaler(held)
    model, history = Linear(start(held.p, classes, seed), 0.0, mean, deviation), []
    model.bias = model.weights[0] * 0.0
    for epoch in range(1, epochs + 1):
        now = Linear(model.weights, model.bias, mean, deviation)

        def step(x, y, now=now):
            z = (x - now.mean) / now.deviation
            diff, told = gradient(z @ now.weights + now.bias, y)
            return [z.T @ diff, diff.sum(axis=0), told]

        slope, lean, told = blocks.summed(held, step)
        model.weights = model.weights - rate * (slope / held.rows + l2 * model.weights)
        model.bias = model.bias - rate * lean / held.rows
        if _reported(epoch, epochs, times):
            history.append({"epoch": epoch, **report(told, model)})
    model.history = history
    return model


def fit_softmax(train: DataFrame, label: str = "label", vector: str = "vector", classes: int | None = None, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, weighted: bool = True, seed: int = 7) -> Linear:
    """Multinomial regression on class codes from 0. Rows weigh by n / (count of their class *
    classes), brought to a mean of 1; the L2 penalty leaves the bias out. The course has loss and
    train accuracy of ten epochs, the first and the last. Without rows this is an error."""
    import numpy as np

    held = blocks.packed(train, vector, F.array(label))
    if not held.rows:
        raise ValueError("no train rows")
    if classes is None:
        classes = int(train.agg(F.max(label)).first()[0]) + 1
    counts = blocks.summed(held, lambda x, y: [np.bincount(y[:, 0].astype(int), minlength=classes).astype(float)])[0]
    weight = held.rows / np.maximum(counts, 1.0) / classes if weighted else np.ones(classes)
    weight = weight * held.rows / (weight * counts).sum()

    def gradient(logits, y):
        code, p = y[:, 0].astype(int), softmax(logits)
        own, here = weight[code], np.arange(len(code))
        told = np.array([-(own * np.log(np.clip(p[here, code], 1e-9, 1.0))).sum(), (p.argmax(axis=1) == code).sum()])
        p[here, code] -= 1
        return p * own[:, None], told

    def report(told, model):
        return {"loss": float(told[0] / held.rows + 0.5 * l2 * (model.weights**2).sum()), "train_accuracy": float(told[1] / held.rows)}

    return _descend(held, classes, seed, epochs, rate, l2, gradient, report, 10)


def softmax_scores(model: Linear, test: DataFrame, vector: str = "vector") -> DataFrame:
    """``test`` with predicted (a class code; the smallest of equals), confidence and probabilities."""

    def predict(x):
        p = softmax(model.logits(x))
        return p.argmax(axis=1).astype("int32"), p.max(axis=1), list(p)

    return blocks.mapped(test, vector, predict, "predicted int, confidence double, probabilities array<double>")


def softmax_predict(train: DataFrame, test: DataFrame, label: str = "label", vector: str = "vector", l2: float = L2, epochs: int = EPOCHS, **settings) -> DataFrame:
    """Fit on ``train`` and score ``test``, which gains predicted and confidence."""
    return softmax_scores(fit_softmax(train, label, vector, l2=l2, epochs=epochs, **settings), test, vector).drop("probabilities")


def hot(true: str, labels: list[str]):
    """An array column with 1 for each of ``labels`` that the set ``true`` holds."""
    return F.array(*[F.coalesce(F.array_contains(true, x), F.lit(False)).cast("double") for x in labels])


def fit_multilabel(train: DataFrame, labels: list[str], true: str = "true_set", vector: str = "vector", epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, seed: int = 7) -> Linear:
    """Logistic regression of all ``labels`` in one fit, one gradient over all of them a step.
    Positive rows weigh (n - count) / count, from 1 to MOST_POSITIVE. The course has the micro F1
    on the train rows of five epochs, the first and the last."""
    import numpy as np

    held = blocks.packed(train, vector, hot(true, labels))
    if not held.rows:
        raise ValueError("no train rows")
    counts = blocks.summed(held, lambda x, y: [y.sum(axis=0)])[0]
    positive = np.clip((held.rows - counts) / np.maximum(counts, 1.0), 1.0, MOST_POSITIVE)

    def gradient(logits, y):
        p = sigmoid(logits)
        told = np.array([((p >= 0.5) & (y > 0)).sum(), ((p >= 0.5) != (y > 0)).sum()], float)
        return (p - y) * np.where(y > 0, positive, 1.0), told

    def report(told, model):
        return {"micro_f1": float(2 * told[0] / (2 * told[0] + told[1])) if told.any() else 0.0}

    return _descend(held, len(labels), seed, epochs, rate, l2, gradient, report, 5)


def multilabel_scores(model: Linear, test: DataFrame, labels: list[str], vector: str = "vector", threshold: float = 0.5) -> DataFrame:
    """``test`` with predicted_set, the labels at ``threshold`` or more, or else the likeliest (the
    first of equals), and probabilities."""
    import numpy as np

    def predict(x):
        p = sigmoid(model.logits(x))
        over = p >= threshold
        none = ~over.any(axis=1)
        over[none, p[none].argmax(axis=1)] = True
        return [[labels[k] for k in np.flatnonzero(r)] for r in over], list(p)

    return blocks.mapped(test, vector, predict, "predicted_set array<string>, probabilities array<double>")


def multilabel_predict(train: DataFrame, test: DataFrame, labels: list[str], true: str = "true_set", vector: str = "vector", threshold: float = 0.5, **settings) -> DataFrame:
    """Fit on ``train`` and score ``test``, which gains predicted_set."""
    return multilabel_scores(fit_multilabel(train, labels, true, vector, **settings), test, labels, vector, threshold).drop("probabilities")
