"""Queries of fitted heads over the vectors of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.operators import descent, numbering, perceptron, retrieval, ridge
from windlass.plans import sql_heads
from windlass.plans.tables import vectors

EPOCHS, CLASSES, ALPHA = 4, 7, 2.0
LABELS = ["even", "third", "low", "seven", "never"]
LEFT = 40
SETTINGS = perceptron.Settings(hidden=16, epochs=3, batch=64)


def _labelled(s, d):
    return vectors(s, d).where("label is not null").select("id", "vector", F.pmod("label", F.lit(CLASSES)).cast("int").alias("label"))


def _sets(s, d):
    v = vectors(s, d).where("label is not null")
    has = (F.col("label") % 2 == 0, F.col("label") % 3 == 0, F.col("id") % 10 < 8, F.col("label") % 7 == 0, F.lit(False))
    return v.select("id", "vector", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in zip(LABELS, has, strict=True)]), lambda x: x.isNotNull()).alias("true_set"))


def _halves(s, d):
    return vectors(s, d).select("id", F.slice("vector", 1, LEFT).alias("x"), F.slice("vector", LEFT + 1, 64 - LEFT).alias("y"))


def _parts(rows):
    return rows.where("id % 4 > 0"), rows.where("id % 4 = 0")


def _softmax(s, d):
    train, test = _parts(_labelled(s, d))
    made = descent.softmax_predict(train, test, classes=CLASSES, epochs=EPOCHS)
    return made.select("id", "label", "predicted", F.round("confidence", 6).alias("confidence"))


def _multilabel(s, d):
    train, test = _parts(_sets(s, d))
    made = descent.multilabel_scores(descent.fit_multilabel(train, LABELS, epochs=EPOCHS), test, LABELS)
    each = made.select("id", "predicted_set", F.posexplode("probabilities").alias("c", "p"))
    name = F.get(F.array(*map(F.lit, LABELS)), F.col("c"))
    return each.select("id", name.alias("label"), F.round("p", 6).alias("p"), F.array_contains("predicted_set", name).alias("predicted"))


def _ridge(s, d):
    train, test = _parts(_halves(s, d))
    made = ridge.ridge_predict(train, test, alpha=ALPHA)
    return made.select("id", F.posexplode("predicted").alias("place", "predicted")).select("id", "place", F.round("predicted", 6).alias("predicted"))


def _ridge_classes(s, d):
    train, test = _parts(_labelled(s, d))
    return ridge.ridge_classify(train, test, CLASSES, "vector").select("id", "label", "predicted")


def _perceptron_classes(s, d):
    train, test = _parts(_labelled(s, d))
    return perceptron.class_scores(perceptron.fit_classifier(train, classes=CLASSES, settings=SETTINGS), test).select("id", "label", "predicted", F.round("confidence", 6).alias("confidence"))


def _perceptron_labels(s, d):
    train, test = _parts(_sets(s, d))
    return perceptron.label_scores(perceptron.fit_multilabel(train, LABELS, settings=SETTINGS), test, LABELS).select("id", F.array_join("predicted_set", "|").alias("predicted"))


def _perceptron_values(s, d):
    train, test = _parts(_halves(s, d))
    made = perceptron.value_scores(perceptron.fit_regressor(train, settings=SETTINGS), test)
    return made.select("id", F.posexplode("predicted").alias("place", "predicted")).select("id", "place", F.round("predicted", 6).alias("predicted"))


SHIFTS, STRESS = [-40, -20, -10, -5, 0, 5, 10, 20, 40], {"language": (1, 16), "motion": (17, 16), "audio": (33, 8)}
_TARGET = (41, 24)


def _alignment(s, d):
    """Vectors as windows in the order of their ids, the last 30 % for tests; each group of features is
    projected into the target's space once."""
    v = vectors(s, d)
    at = lambda part: F.slice("vector", part[0], part[1])
    made = None
    for name, part in STRESS.items():
        rows = numbering.by_order(v.select("id", at(part).alias("x"), at(_TARGET).alias("y")), [], ["id"])
        k = F.greatest(F.lit(1), F.least(F.bround(F.col("_n") * 0.7), F.col("_n") - 1)).cast("long")
        rows = rows.withColumn("place", F.col("_at") - 1 - k)
        train, test = rows.where("place < 0"), rows.where("place >= 0")
        model = ridge.fit_ridge(train, alpha=ALPHA)
        part = ridge.standard_scores(model, test).select(F.lit(name).alias("group"), "place", "predicted", "vector")
        made = part if made is None else made.unionByName(part)
    ranked = retrieval.shifted_ranks(made, SHIFTS)
    return ranked.groupBy("group", "shift").agg(F.count("*").alias("queries"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg((F.col("rank") <= 5).cast("double")), 6).alias("top_5"))


def _sql_alignment():
    parts = []
    for name, (a, n) in STRESS.items():
        parts.append(f"""SELECT * FROM (WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS i, count(*) OVER () AS n FROM embeddings),
rows AS MATERIALIZED (SELECT i - 1 - greatest(1, least(round_even(n * 0.7, 0), n - 1)) AS id, i <= greatest(1, least(round_even(n * 0.7, 0), n - 1)) AS train, embedding[{a}:{a + n - 1}]::DOUBLE[] AS x, embedding[{_TARGET[0]}:{_TARGET[0] + _TARGET[1] - 1}]::DOUBLE[] AS y FROM o),
{sql_heads.ridge(n, _TARGET[1], ALPHA)},
pairs AS MATERIALIZED (SELECT id, list((v - m) / s ORDER BY k) AS t, list((p - m) / s ORDER BY k) AS p FROM scored JOIN t_0 USING (id, k) JOIN t_s USING (k) GROUP BY id),
cos AS MATERIALIZED (SELECT q.id AS q, c.id AS c, list_cosine_similarity(q.p, c.t) AS v FROM pairs q, pairs c),
size AS (SELECT count(*) AS n FROM pairs),
own AS (SELECT shift, q, c, v FROM cos, (SELECT unnest({SHIFTS}) AS shift) WHERE q - c = shift),
ranks AS (SELECT own.shift, own.c, 1 + count(*) FILTER (x.v > own.v + 1e-12 OR (abs(x.v - own.v) <= 1e-12 AND x.c < own.c)) AS r FROM own JOIN cos x ON x.q = own.q, size WHERE x.c + own.shift BETWEEN 0 AND n - 1 GROUP BY 1, 2)
SELECT '{name}' AS "group", CAST(shift AS BIGINT) AS shift, count(*) AS queries, round(avg(1.0 / r), 6) AS mrr, round(avg(r), 6) AS mean_rank, round(avg(CAST(r <= 5 AS INTEGER)), 6) AS top_5 FROM ranks GROUP BY shift)""")
    return " UNION ALL ".join(parts)


def _future(s, d):
    """The second half of a vector is its future; labels stand for episodes."""
    v = vectors(s, d)
    q = v.where("id % 20 = 0").select("id", F.slice("vector", 1, 32).alias("vector"), F.col("id").alias("target"))
    c = v.select("id", F.slice("vector", 33, 32).alias("vector"))
    best = retrieval.top_k(q, c, 1, "l2", exclude_self=False)
    made = retrieval.future_metrics(retrieval.ranks(q, c, "l2"), best, v.select("id", F.col("label").alias("episode")), 32)
    return made.select("queries", *[F.round(x, 6).alias(x) for x in made.columns if x != "queries"])


SQL_FUTURE = """WITH v AS (SELECT vec_id AS id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b, label FROM embeddings),
p AS (SELECT q.id, q.label, c.id AS c, c.label AS their, list_sum(list_transform(list_zip(q.a, c.b), lambda z: (z[1] - z[2]) ** 2)) AS d FROM v q, v c WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, c) AS r FROM p)
SELECT count(*) AS queries, round(avg(1.0 / r), 6) AS mrr, round(avg(CAST(r <= 5 AS INTEGER)), 6) AS recall_at_5, round((SELECT avg(CAST(coalesce(label = their, false) AS INTEGER)) FROM r WHERE r = 1), 6) AS temporal_consistency, round(avg(sqrt(d) / sqrt(32)), 6) AS reconstruction_error FROM r WHERE id = c"""

SQL_VECTORS = "vec_id AS id, vec_id % 4 > 0 AS train"
SQL_LABELLED = f"rows AS MATERIALIZED (SELECT {SQL_VECTORS}, embedding::DOUBLE[] AS x, CAST(((label % {CLASSES}) + {CLASSES}) % {CLASSES} AS INTEGER) AS y FROM embeddings WHERE label IS NOT NULL)"
SQL_SETS = f"rows AS MATERIALIZED (SELECT {SQL_VECTORS}, embedding::DOUBLE[] AS x, [label % 2 = 0, label % 3 = 0, vec_id % 10 < 8, label % 7 = 0, false]::INTEGER[] AS y FROM embeddings WHERE label IS NOT NULL)"
SQL_HALVES = f"rows AS MATERIALIZED (SELECT {SQL_VECTORS}, embedding[1:{LEFT}]::DOUBLE[] AS x, embedding[{LEFT + 1}:64]::DOUBLE[] AS y FROM embeddings)"
SQL_HOT = f"rows AS MATERIALIZED (SELECT id, train, x, y AS label, list_transform(range(0, {CLASSES}), lambda k: CAST(k = y AS DOUBLE)) AS y FROM labelled)"

QUERIES = {
    "softmax_head": (_softmax, f"WITH {SQL_LABELLED}, {sql_heads.softmax(64, CLASSES, EPOCHS)} SELECT id, y AS label, predicted, round(confidence, 6) AS confidence FROM scored"),
    "multilabel_head": (_multilabel, f"WITH {SQL_SETS}, {sql_heads.multilabel(64, len(LABELS), EPOCHS)} SELECT id, {LABELS}[CAST(c + 1 AS INTEGER)] AS label, round(p, 6) AS p, on_ AS predicted FROM scored"),
    "ridge_head": (_ridge, f"WITH RECURSIVE {SQL_HALVES}, {sql_heads.ridge(LEFT, 64 - LEFT, ALPHA)} SELECT id, CAST(k - 1 AS INTEGER) AS place, round(p, 6) AS predicted FROM scored"),
    "ridge_class_head": (
        _ridge_classes,
        f"WITH RECURSIVE {SQL_LABELLED.replace('rows AS', 'labelled AS', 1)}, {SQL_HOT}, {sql_heads.ridge(64, CLASSES, 1.0, False)} SELECT id, any_value(label) AS label, CAST(arg_max(k - 1, (p, -k)) AS INTEGER) AS predicted FROM scored JOIN rows USING (id) GROUP BY id",
    ),
    "alignment_shift_ranks": (_alignment, _sql_alignment()),
    "future_retrieval_metrics": (_future, SQL_FUTURE),
    "perceptron_classes": (_perceptron_classes, None),
    "perceptron_labels": (_perceptron_labels, None),
    "perceptron_values": (_perceptron_values, None),
}
