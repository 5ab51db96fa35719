"""SQL of the fitted heads: unrolled descent steps and elimination, for DuckDB."""

from __future__ import annotations

from windlass.operators import descent


def scaled(rows: str, name: str = "z") -> str:
    """``name`` (id, train, j, v): the vectors x of ``rows`` (id, train, x), standardised by train rows."""
    return f"""{name}_x AS MATERIALIZED (SELECT id, train, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM {rows}),
{name}_s AS MATERIALIZED (SELECT j, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-6 THEN 1.0 ELSE stddev_pop(v) END AS s FROM {name}_x WHERE train GROUP BY j),
{name} AS MATERIALIZED (SELECT id, train, j, (v - m) / s AS v FROM {name}_x JOIN {name}_s USING (j))"""


def _start(features: int, classes: int, seed: int) -> str:
    w = descent.start(features, classes, seed)
    cells = ", ".join(f"({j + 1}, {c}, {w[j, c]!r}::DOUBLE)" for j in range(features) for c in range(classes)).replace("np.float64(", "(")
    return f"w0 AS MATERIALIZED (SELECT * FROM (VALUES {cells}) t(j, c, w)), b0 AS MATERIALIZED (SELECT DISTINCT c, 0.0::DOUBLE AS b FROM w0)"


def _steps(epochs: int, rate: float, l2: float, activation: str, slope: str) -> str:
    """w1, b1, w2, b2, ...: ``activation`` of the logits l by row and class, ``slope`` of p and y."""
    made = []
    for k in range(epochs):
        made.append(f"""l{k} AS MATERIALIZED (SELECT id, c, sum(v * w) + any_value(b) AS l FROM z JOIN w{k} USING (j) JOIN b{k} USING (c) WHERE train GROUP BY id, c),
d{k} AS MATERIALIZED (SELECT id, c, {slope} / (SELECT count(*) FROM rows WHERE train) AS d FROM (SELECT id, c, {activation} AS p FROM l{k}) JOIN ys USING (id, c)),
w{k + 1} AS MATERIALIZED (SELECT j, c, w - {rate!r} * (g + {l2!r} * w) AS w FROM w{k} JOIN (SELECT j, c, sum(v * d) AS g FROM z JOIN d{k} USING (id) GROUP BY j, c) USING (j, c)),
b{k + 1} AS MATERIALIZED (SELECT c, b - {rate!r} * g AS b FROM b{k} JOIN (SELECT c, sum(d) AS g FROM d{k} GROUP BY c) USING (c))""")
    return ",\n".join(made)


def softmax(features: int, classes: int, epochs: int, rate: float = descent.RATE, l2: float = descent.L2, seed: int = 7) -> str:
    """CTEs up to ``scored`` (id, y, predicted, confidence) of the test rows of ``rows`` (id, train, x, y)."""
    soft = "exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY id)"
    logits = lambda src: f"(SELECT *, max(l) OVER (PARTITION BY id) AS m FROM {src})"
    steps = _steps(epochs, rate, l2, soft, "(p - t) * own")
    for k in range(epochs):
        steps = steps.replace(f"AS p FROM l{k})", f"AS p FROM {logits(f'l{k}')})")
    return f"""{scaled("rows")}, {_start(features, classes, seed)},
n_y AS (SELECT y, count(*) AS n FROM rows WHERE train GROUP BY 1),
own_0 AS (SELECT y, n, (SELECT sum(n) FROM n_y) / n / {classes} AS w FROM n_y),
own AS (SELECT y, w * (SELECT sum(n) FROM own_0) / (SELECT sum(n * w) FROM own_0) AS own FROM own_0),
ys AS MATERIALIZED (SELECT id, c, CAST(y = c AS INTEGER) AS t, own FROM rows JOIN own USING (y), (SELECT DISTINCT c FROM w0) WHERE train),
{steps},
last AS MATERIALIZED (SELECT id, c, sum(v * w) + any_value(b) AS l FROM z JOIN w{epochs} USING (j) JOIN b{epochs} USING (c) WHERE NOT train GROUP BY id, c),
scored AS MATERIALIZED (SELECT id, any_value(y) AS y, CAST(arg_max(c, (p, -c)) AS INTEGER) AS predicted, max(p) AS confidence FROM (SELECT id, c, {soft} AS p FROM {logits("last")}) JOIN rows USING (id) GROUP BY id)"""


def multilabel(features: int, labels: int, epochs: int, rate: float = descent.RATE, l2: float = descent.L2, seed: int = 7) -> str:
    """CTEs up to ``scored`` (id, c, on): the classes of the test rows of ``rows`` (id, train, x, y), y
    a list of 0 and 1."""
    sigmoid = "1 / (1 + exp(-greatest(-40, least(40, l))))"
    return f"""{scaled("rows")}, {_start(features, labels, seed)},
y_0 AS (SELECT id, train, unnest(range(0, {labels})) AS c, unnest(y) AS t FROM rows),
pos AS (SELECT c, greatest(1.0, least({descent.MOST_POSITIVE!r}, (count(*) - sum(t)) / greatest(sum(t), 1))) AS pos FROM y_0 WHERE train GROUP BY c),
ys AS MATERIALIZED (SELECT id, c, t, CASE WHEN t > 0 THEN pos ELSE 1.0 END AS own FROM y_0 JOIN pos USING (c) WHERE train),
{_steps(epochs, rate, l2, sigmoid, "(p - t) * own")},
last AS MATERIALIZED (SELECT id, c, sum(v * w) + any_value(b) AS l FROM z JOIN w{epochs} USING (j) JOIN b{epochs} USING (c) WHERE NOT train GROUP BY id, c),
scored AS MATERIALIZED (SELECT id, c, p, p >= 0.5 OR (max(p) OVER (PARTITION BY id) < 0.5 AND row_number() OVER (PARTITION BY id ORDER BY p DESC, c) = 1) AS on_ FROM (SELECT id, c, {sigmoid} AS p FROM last))"""


def ridge(features: int, targets: int, alpha: float, standardize_y: bool = True) -> str:
    """CTEs up to ``scored`` (id, k, p): predictions by target, from 1, of the test rows of ``rows`` (id,
    train, x, y), y a list. The normal equations are solved by elimination."""
    scale = "CASE WHEN stddev_pop(v) < 1e-6 THEN 1.0 ELSE stddev_pop(v) END" if standardize_y else "1.0"
    bias = "m" if standardize_y else f"m * (SELECT count(*) FROM rows WHERE train) / ((SELECT count(*) FROM rows WHERE train) + {alpha!r})"
    return f"""{scaled("rows")},
t_0 AS MATERIALIZED (SELECT id, train, unnest(range(1, len(y) + 1)) AS k, unnest(y) AS v FROM rows),
t_s AS MATERIALIZED (SELECT k, avg(v) AS m, {scale} AS s FROM t_0 WHERE train GROUP BY k),
t AS MATERIALIZED (SELECT id, k, (v - m) / s AS v FROM t_0 JOIN t_s USING (k) WHERE train),
cells AS MATERIALIZED (
  SELECT a.j AS i, b.j AS j, sum(a.v * b.v) + CASE WHEN a.j = b.j THEN {alpha!r} ELSE 0 END AS v FROM z a JOIN z b ON a.id = b.id WHERE a.train GROUP BY a.j, b.j
  UNION ALL SELECT z.j, {features} + t.k, sum(z.v * t.v) FROM z JOIN t ON z.id = t.id WHERE z.train GROUP BY z.j, t.k),
system AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM cells GROUP BY i)),
solved AS (
  SELECT 1 AS k, m FROM system
  UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN pr ELSE list_transform(r, lambda v, j: v - r[k] * pr[j]) END)
  FROM (SELECT k, m, list_transform(m[k], lambda v: v / m[k][k]) AS pr FROM solved WHERE k <= {features})),
weights AS MATERIALIZED (SELECT j, k, m[j][{features} + k] AS w FROM (SELECT m FROM solved WHERE k = {features + 1}), range(1, {features + 1}) a(j), range(1, {targets + 1}) b(k)),
scored AS MATERIALIZED (SELECT id, k, sum(v * w) * any_value(s) + any_value({bias}) AS p FROM z JOIN weights USING (j) JOIN t_s USING (k) WHERE NOT train GROUP BY id, k)"""
