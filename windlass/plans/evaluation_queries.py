"""Metric, retrieval, comparison and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.functions import text as tx
from windlass.operators import features, joins, metrics, quality, retrieval, slices
from windlass.plans.tables import table, vectors

#: Predictions to score: a document's true label is its source's group, its predicted one comes
#: from its length, so that some classes are predicted and never true.
SQL_PRED = """WITH p AS (
  SELECT doc_id, lang, source, 'c' || (doc_id % 5) AS true_label, 'c' || (n_chars % 7) AS predicted_label,
         list_distinct([CAST(doc_id % 3 AS VARCHAR), CAST(doc_id % 4 AS VARCHAR)]) AS true_set, list_distinct([CAST(n_chars % 3 AS VARCHAR), CAST(n_chars % 5 AS VARCHAR)]) AS predicted_set,
         CAST(doc_id % 10 < 3 AS INTEGER) AS y, CAST(n_chars % 10 < 4 AS INTEGER) AS p, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split
  FROM documents)"""
SQL_CLASS = (
    SQL_PRED
    + """, s AS (SELECT true_label AS label, 1 AS t, 0 AS g, CAST(true_label = predicted_label AS INTEGER) AS h FROM p UNION ALL SELECT predicted_label, 0, 1, 0 FROM p),
c AS (SELECT label, sum(t) AS support, sum(g) AS predicted, sum(h) AS tp FROM s GROUP BY 1),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)"""
)


def predictions(s, d):
    doc, n = F.col("doc_id"), F.col("n_chars")
    name = lambda c, k: F.concat(F.lit("c"), (c % k).cast("string"))
    return table(s, d, "documents").select(
        "doc_id", "lang", "source", name(doc, 5).alias("true_label"), name(n, 7).alias("predicted_label"),
        F.array_distinct(F.array((doc % 3).cast("string"), (doc % 4).cast("string"))).alias("true_set"),
        F.array_distinct(F.array((n % 3).cast("string"), (n % 5).cast("string"))).alias("predicted_set"),
        (doc % 10 < 3).cast("int").alias("y"), (n % 10 < 4).cast("int").alias("p"), F.when(doc % 4 == 0, "test").otherwise("train").alias("split"),
    )


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def _per_class(s, d):
    return rounded(metrics.per_class(predictions(s, d)))


def _classes(s, d):
    listed = s.range(9).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("label"))
    return rounded(metrics.classification(predictions(s, d), listed))


def _halves(s, d):
    """Each vector as a query for its second half by its first."""
    v = vectors(s, d)
    q = v.where("id % 20 = 0").select("id", F.slice("vector", 1, 32).alias("vector"), F.col("id").alias("target"))
    return q, v.select("id", F.slice("vector", 33, 32).alias("vector"))


def _rank(measure):
    def run(s, d):
        return rounded(retrieval.ranks(*_halves(s, d), measure))

    return run


SQL_HALVES = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT id, e[1:32] AS a FROM v WHERE id % 20 = 0), c AS (SELECT id, e[33:64] AS b FROM v),"""
SQL_COS = SQL_HALVES + """ s AS (SELECT q.id, c.id AS cid, list_dot_product(a, b) / (greatest(sqrt(list_dot_product(a, a)), 1e-8) * greatest(sqrt(list_dot_product(b, b)), 1e-8)) AS score FROM q CROSS JOIN c),
r AS (SELECT id, cid, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, cid) AS rank FROM s)"""


def _retrieval(s, d):
    return rounded(retrieval.summary(retrieval.ranks(*_halves(s, d))))


def _top5(s, d):
    v = vectors(s, d).select("id", "vector")
    return rounded(retrieval.top_k(v.where("id % 20 = 0"), v, 5))


def _centroid(s, d):
    v = vectors(s, d).withColumn("split", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    table_ = retrieval.centroids(v.where("split = 'train'"))
    return retrieval.centroid_predict(v.where("split = 'test'"), table_).select("id", "label", "predicted")


def _forecast(s, d):
    """The second half of each vector from its first, place by place."""
    v = vectors(s, d).select("id", F.posexplode(F.arrays_zip(F.slice("vector", 1, 32).alias("x"), F.slice("vector", 33, 32).alias("y"))).alias("place", "z")).select("id", "place", "z.x", "z.y")
    return rounded(retrieval.mean_delta_forecast(v.where("id % 3 <> 0"), v.where("id % 3 = 0"), "x", "y").select("id", "place", "predicted"))


def _regression(s, d):
    v = vectors(s, d).select(*[F.col("vector")[k].alias(f"v{k}") for k in range(64)])
    return rounded(metrics.regression(v, [(f"v{k}", f"v{k + 32}") for k in range(32)]))


def _joints(s, d):
    triples = lambda a: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.slice("vector", k * 3 + a, 3))
    v = vectors(s, d).select(triples(1).alias("t"), triples(31).alias("p"))
    return rounded(metrics.joint_error(v, "t", "p"))


def _slices(s, d):
    p = predictions(s, d).withColumn("exact", (F.col("true_label") == F.col("predicted_label")).cast("int")).withColumn("parsed", (F.col("doc_id") % 9 != 0).cast("int"))
    return slices.error_slices(p, ["lang", "split", "true_set"], ["exact", "parsed"], ("true_set", "predicted_set"))


def _variants(s, d):
    p = predictions(s, d).groupBy(F.col("true_label").alias("task"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("variant"))
    scores = p.agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("score"))
    return rounded(slices.compare_variants(scores.where("variant <> 'v2'"), "v0", "v1", F.col("task") != "c3"))


def _answers(s, d):
    """Model replies from conversations, in the forms that models give them."""
    c = table(s, d, "conversations")
    word = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    body = F.concat(F.lit('{"action": " '), word, F.lit('. ", "subtask": "", "objects": ["Cup", "cup", "'), word, F.lit('", ""], "contact": "YES", "transition": "no", "next_action": "'), word, F.lit('", "evidence_window": {"start_frame": '), F.col("turn").cast("string"), F.lit("}}"))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Sure: "), body, F.lit(" done."))).when(kind == 3, F.lit("[1, 2]")).otherwise(F.lit("no json"))
    return c.select("conv_id", "turn", word.alias("word"), raw.alias("raw"))


def _canonical(s, d):
    return _answers(s, d).select("conv_id", "turn", tx.answer_is_valid(F.col("raw")).alias("valid"), tx.canonical_json(tx.canonical_answer(tx.parse_answer(F.col("raw")))).alias("answer"))


def _links(s, d):
    return quality.page_links(table(s, d, "pages")).groupBy("path").agg(F.count("*").alias("links"), F.count_distinct("page").alias("pages"))


def _broken(s, d):
    links = quality.page_links(table(s, d, "pages"))
    targets = links.select("path").distinct().where(F.length("path") % 3 != 0)
    return quality.broken_links(links, targets, targets.select("path", F.lit("top").alias("id"))).groupBy("check", "key").agg(F.count("*").alias("n"))


def _parity(s, d):
    c = table(s, d, "customer").select("c_custkey", F.md5("c_name").alias("digest"))
    right = c.where("c_custkey % 7 <> 0").withColumn("digest", F.when(F.col("c_custkey") % 11 == 0, F.lit("x")).otherwise(F.col("digest")))
    return joins.parity(c.where("c_custkey % 5 <> 0"), right, "c_custkey", "digest").select("c_custkey", "state")


def _violations(s, d):
    p = predictions(s, d)
    made = quality.union(
        quality.split_leaks(p, "source"), quality.split_counts(p, {"train": 1, "test": 2, "val": 0}),
        quality.duplicate_ids(p.select((F.col("doc_id") % 900).alias("id")), "id"), quality.forbidden_text(table(s, d, "documents"), "doc_id", "text"),
    )
    return quality.issue_summary(made)


def _coverage(s, d):
    c = table(s, d, "conversations").select("conv_id").distinct()
    done = table(s, d, "conversations").where("role = 'system'")
    return joins.coverage(c, done, "conv_id").groupBy("covered").agg(F.count("*").alias("n"))


def _dups(s, d):
    p = table(s, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    return joins.keep_first(p, "digest", ["doc_id"]).where("duplicate").select("doc_id")


def _norms(s, d):
    return rounded(features.block_norms(vectors(s, d).select("id", "vector"), "vector").drop("vector"))


def _cloud(s, d):
    v = vectors(s, d).select("label", *[F.col("vector")[k].alias(a) for k, a in enumerate("xyz")])
    return features.cloud_summary(v, "label", ["x", "y", "z"])


def _confusion(s, d):
    return metrics.confusion(predictions(s, d))


QUERIES = {
    "multiclass_confusion": (_confusion, SQL_PRED + " SELECT true_label, predicted_label, count(*) AS n FROM p GROUP BY 1, 2"),
    "confusion_wide": (
        lambda s, d: metrics.confusion_wide(predictions(s, d), [f"c{k}" for k in range(7)]),
        SQL_PRED + " SELECT true_label, " + ", ".join(f"count(*) FILTER (predicted_label = 'c{k}') AS c{k}" for k in range(7)) + " FROM p GROUP BY 1",
    ),
    "per_class_metrics": (_per_class, SQL_CLASS + " SELECT label, support::BIGINT AS support, predicted::BIGINT AS predicted, tp::BIGINT AS tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f"),
    "macro_f1_variants": (
        _classes,
        SQL_CLASS
        + """ SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1) FILTER (support > 0), 6) AS macro_f1_supported, round(avg(f1), 6) AS macro_f1_seen,
round(sum(f1) / 9, 6) AS macro_f1_listed, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM f""",
    ),
    "macro_f1_fixed": (lambda s, d: rounded(metrics.macro_f1_fixed(predictions(s, d), 10)), SQL_CLASS + " SELECT round(sum(f1) / 10, 6) AS macro_f1 FROM f"),
    "binary_metrics": (
        lambda s, d: rounded(metrics.binary(predictions(s, d))),
        SQL_PRED
        + """, c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM p)
SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
round((tp + fn) / (tp + tn + fp + fn), 6) AS true_rate, round((tp + fp) / (tp + tn + fp + fn), 6) AS predicted_rate FROM c""",
    ),
    "multilabel_micro_f1": (
        lambda s, d: rounded(metrics.multilabel(predictions(s, d), list("012345"))),
        SQL_PRED
        + """, v AS (SELECT unnest(['0', '1', '2', '3', '4', '5']) AS v), c AS (SELECT v, count(*) FILTER (list_contains(true_set, v) AND list_contains(predicted_set, v)) AS tp,
count(*) FILTER (NOT list_contains(true_set, v) AND list_contains(predicted_set, v)) AS fp, count(*) FILTER (list_contains(true_set, v) AND NOT list_contains(predicted_set, v)) AS fn FROM p CROSS JOIN v GROUP BY 1)
SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END), 6) AS macro_f1,
(SELECT round(avg((list_sort(true_set) = list_sort(predicted_set))::INTEGER), 6) FROM p) AS exact_match FROM c""",
    ),
    "set_micro_f1": (
        lambda s, d: rounded(metrics.set_f1(predictions(s, d), "true_set", "predicted_set")),
        SQL_PRED + " SELECT round(2 * sum(len(list_intersect(true_set, predicted_set))) / (sum(len(true_set)) + sum(len(predicted_set))), 6) AS object_micro_f1 FROM p",
    ),
    "majority_baseline": (
        lambda s, d: rounded(metrics.majority_baseline(predictions(s, d).where("split = 'train'").withColumn("label", F.col("lang")), predictions(s, d).where("split = 'test'").withColumn("label", F.col("lang")))),
        SQL_PRED + ", b AS (SELECT lang FROM p WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT b.lang AS majority_label, round(avg((p.lang = b.lang)::INTEGER), 6) AS accuracy, count(*) AS n FROM p, b WHERE split = 'test' GROUP BY 1",
    ),
    "seen_unseen_accuracy": (
        lambda s, d: rounded(metrics.seen_accuracy(predictions(s, d).where("split = 'test'"), predictions(s, d).where("split = 'train' and doc_id % 5 < 3").select(F.col("true_label").alias("label")))),
        SQL_PRED + " SELECT true_label IN (SELECT true_label FROM p WHERE split = 'train' AND doc_id % 5 < 3) AS seen, count(*) AS n, round(avg((true_label = predicted_label)::INTEGER), 6) AS accuracy FROM p WHERE split = 'test' GROUP BY 1",
    ),
    "field_accuracy": (
        lambda s, d: rounded(metrics.field_accuracy(predictions(s, d).withColumn("t", F.when(F.col("doc_id") % 6 == 0, "unknown").otherwise(F.col("true_label"))), {"action": ("t", "predicted_label")})),
        SQL_PRED + " SELECT round(avg((true_label = predicted_label)::INTEGER) FILTER (doc_id % 6 <> 0), 6) AS action FROM p",
    ),
    "regression_metrics": (
        _regression,
        """WITH v AS (SELECT unnest(range(32)) AS k, unnest((embedding::DOUBLE[])[1:32]) AS a, unnest((embedding::DOUBLE[])[33:64]) AS b FROM embeddings), t AS (SELECT k, sum(pow(a - b, 2)) AS s, count(*) * var_pop(a) AS v, sum(abs(a - b)) AS m, count(*) AS n FROM v GROUP BY 1)
SELECT round(sum(s) / sum(n), 6) AS mse, round(sum(m) / sum(n), 6) AS mae, round(1 - sum(s) / sum(v), 6) AS r2 FROM t""",
    ),
    "joint_position_error": (
        _joints,
        """WITH g AS (SELECT vec_id, k, sqrt(sum(pow(embedding[k * 3 + 1 + j]::DOUBLE - embedding[k * 3 + 31 + j]::DOUBLE, 2))) AS g FROM embeddings, range(10) a(k), range(3) b(j) GROUP BY 1, 2)
SELECT round(avg(g), 6) AS mpjpe, round(avg(g) FILTER (k = 9), 6) AS final_mpjpe FROM g""",
    ),
    "retrieval_ranks_cosine": (_rank("cosine"), SQL_COS + " SELECT id, rank, round(score, 6) AS score FROM r WHERE id = cid"),
    "retrieval_mrr_cosine": (
        _retrieval,
        SQL_COS
        + """ SELECT count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, round(quantile_cont(rank, 0.5), 6) AS median_rank,
round(avg((rank <= 1)::INTEGER), 6) AS top_1, round(avg((rank <= 5)::INTEGER), 6) AS top_5, round(avg((rank <= 10)::INTEGER), 6) AS top_10 FROM r WHERE id = cid""",
    ),
    "future_retrieval_l2": (
        _rank("l2"),
        SQL_HALVES
        + """ s AS (SELECT q.id, c.id AS cid, pow(list_distance(a, b), 2) AS d2 FROM q CROSS JOIN c), r AS (SELECT id, cid, d2, row_number() OVER (PARTITION BY id ORDER BY d2, cid) AS rank FROM s)
SELECT id, rank, round(-d2, 6) AS score FROM r WHERE id = cid""",
    ),
    "retrieval_top5": (
        _top5,
        """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.id, c.id AS candidate, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate) AS place FROM s) SELECT id, CAST(place AS INTEGER) AS place, candidate, round(score, 6) AS score FROM r WHERE place <= 5""",
    ),
    "centroid_classifier": (
        _centroid,
        """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), u AS (SELECT label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v WHERE id % 4 <> 0),
m AS (SELECT label, k, avg(u[k]) AS m, count(*) AS n FROM u, range(1, 65) t(k) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY k) AS c, max(n) AS n FROM m GROUP BY 1),
s AS (SELECT v.id, v.label, c.label AS predicted, list_dot_product(v.e, c.c) / sqrt(list_dot_product(v.e, v.e)) / sqrt(list_dot_product(c.c, c.c)) + 0.03 * ln(c.n / (SELECT sum(n) FROM c)) AS s FROM v CROSS JOIN c WHERE v.id % 4 = 0)
SELECT id, label, predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, predicted) AS r FROM s) WHERE r = 1""",
    ),
    "mean_delta_forecast": (
        _forecast,
        """WITH v AS (SELECT vec_id AS id, CAST(unnest(range(32)) AS INTEGER) AS place, unnest((embedding::DOUBLE[])[1:32]) AS x, unnest((embedding::DOUBLE[])[33:64]) AS y FROM embeddings),
t AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM v WHERE id % 3 <> 0) SELECT id, place, round((x - mx) / sx * sy + my, 6) AS predicted FROM v, t WHERE id % 3 = 0""",
    ),
    "error_slices": (
        _slices,
        SQL_PRED
        + """, e AS (SELECT *, (true_label = predicted_label)::INTEGER AS exact, (doc_id % 9 <> 0)::INTEGER AS parsed, len(list_intersect(true_set, predicted_set)) AS tp, len(true_set) AS t, len(predicted_set) AS g FROM p),
x AS (SELECT 'lang' AS slice, lang AS "group", exact, parsed, tp, t, g FROM e UNION ALL SELECT 'split', split, exact, parsed, tp, t, g FROM e UNION ALL SELECT 'true_set', unnest(true_set), exact, parsed, tp, t, g FROM e)
SELECT slice, "group", count(*) AS samples, round(avg(exact), 6) AS exact_rate, round(avg(parsed), 6) AS parsed_rate, round(sum(tp) / sum(g), 6) AS object_precision, round(sum(tp) / sum(t), 6) AS object_recall,
round(2 * sum(tp) / (sum(g) + sum(t)), 6) AS object_f1 FROM x GROUP BY 1, 2""",
    ),
    "variant_comparison": (
        _variants,
        SQL_PRED
        + """, s AS (SELECT true_label AS task, doc_id % 3 AS v, avg((true_label = predicted_label)::INTEGER) AS score FROM p GROUP BY 1, 2),
w AS (SELECT task, max(score) FILTER (v = 0) AS base, max(score) FILTER (v = 1) AS other FROM s GROUP BY 1), g AS (SELECT *, CASE WHEN task <> 'c3' THEN other - base ELSE base - other END AS gain FROM w)
SELECT task, round(base, 6) AS base, round(other, 6) AS other, round(gain, 6) AS gain, round(gain / nullif(abs(base), 0), 6) AS relative_gain, CASE WHEN abs(gain) <= 1e-9 THEN 'tie' WHEN gain > 0 THEN 'better' ELSE 'worse' END AS verdict FROM g""",
    ),
    "family_summary": (
        lambda s, d: slices.family_summary(predictions(s, d), "lang", "y", "p"),
        SQL_PRED + " SELECT lang, count(*) AS samples, round(avg(y), 6) AS seen_share, round(avg(p), 6) AS accuracy FROM p GROUP BY 1",
    ),
    "singleton_share": (
        lambda s, d: slices.singleton_share(table(s, d, "documents"), "n_chars"),
        "WITH c AS (SELECT n_chars, count(*) AS c FROM documents GROUP BY 1) SELECT count(*) AS labels, round(avg((c = 1)::INTEGER), 6) AS singleton_share FROM c",
    ),
    "label_cardinality": (
        lambda s, d: slices.label_cardinality(predictions(s, d).withColumn("l", F.col("doc_id") % 997), "l"),
        SQL_PRED + ", l AS (SELECT DISTINCT doc_id % 997 AS l, split FROM p) SELECT split, count(*) AS labels, count(*) FILTER (l NOT IN (SELECT l FROM l WHERE split = 'train')) AS not_in_train FROM l GROUP BY 1",
    ),
    "top_labels": (
        lambda s, d: slices.top_labels(predictions(s, d), "source", "doc_id", k=5),
        SQL_PRED + ", c AS (SELECT split, source, count(*) AS n, min(doc_id) AS f FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, f) AS place FROM c) SELECT split, source, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5",
    ),
    "canonical_answers": (
        _canonical,
        """WITH a AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS w, (conv_id + turn) % 5 AS k FROM conversations)
SELECT conv_id, turn, k < 3 AS valid, CASE WHEN k < 3 THEN '{"action":"' || CASE WHEN w = '' THEN 'unknown' ELSE w END || '","contact":"yes","evidence_window":{"start_frame":' || turn || ',"end_frame":0},"next_action":"' || CASE WHEN w = '' THEN 'unknown' ELSE w END
  || '","objects":["Cup"' || CASE WHEN w = '' OR lower(w) = 'cup' THEN '' ELSE ',"' || w || '"' END || '],"subtask":"unknown","transition":"no"}'
  ELSE '{"action":"unknown","contact":"unknown","evidence_window":{"start_frame":0,"end_frame":0},"next_action":"unknown","objects":[],"subtask":"unknown","transition":"unknown"}' END AS answer FROM a""",
    ),
    "page_link_targets": (
        _links,
        """WITH l AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '(?i)\\bhref="([^"]*)"', 1), regexp_extract_all(html, '(?i)\\bsrc="([^"]*)"', 1))) AS link FROM pages)
SELECT url_decode(replace(split_part(link, '#', 1), '+', ' ')) AS path, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY 1""",
    ),
    "broken_links": (
        _broken,
        """WITH l AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '(?i)\\bhref="([^"]*)"', 1), regexp_extract_all(html, '(?i)\\bsrc="([^"]*)"', 1))) AS link FROM pages),
p AS (SELECT *, url_decode(replace(split_part(link, '#', 1), '+', ' ')) AS path, split_part(link, '#', 2) AS frag FROM l WHERE NOT regexp_matches(link, '^([a-z][a-z0-9+.-]*:|//)')),
b AS (SELECT CASE WHEN length(path) % 3 = 0 THEN 'dead_link' WHEN frag <> '' AND frag <> 'top' THEN 'dead_anchor' END AS c, page_id FROM p WHERE path <> '')
SELECT c AS "check", CAST(page_id AS VARCHAR) AS key, count(*) AS n FROM b WHERE c IS NOT NULL GROUP BY 1, 2""",
    ),
    "listing_parity": (
        _parity,
        """WITH l AS (SELECT c_custkey AS k, 'same' AS d FROM customer WHERE c_custkey % 5 <> 0), r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE 'same' END AS d FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(l.k, r.k) AS c_custkey, CASE WHEN l.k IS NULL THEN 'only_right' WHEN r.k IS NULL THEN 'only_left' ELSE 'differs' END AS state FROM l FULL JOIN r ON l.k = r.k WHERE l.d IS DISTINCT FROM r.d""",
    ),
    "violation_summary": (
        _violations,
        SQL_PRED
        + """, l AS (SELECT source, string_agg(DISTINCT split, '|' ORDER BY split) AS splits FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1), c AS (SELECT split AS k, count(*) AS n FROM p GROUP BY 1),
w AS (SELECT * FROM (VALUES ('train', 1), ('test', 2), ('val', 0)) w(k, want)), d AS (SELECT doc_id % 900 AS id, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT doc_id, unnest(["""
        + ", ".join(f"CASE WHEN regexp_matches(text, '{x}') THEN '{n}' END" for n, x in quality.FORBIDDEN.items())
        + """]) AS n FROM documents),
v AS (SELECT 'split_leak' AS "check", source AS key, splits AS detail FROM l UNION ALL SELECT 'split_count', coalesce(w.k, c.k), coalesce(n, 0) || '/' || coalesce(want, 0) FROM w FULL JOIN c ON c.k = w.k WHERE coalesce(n, 0) <> coalesce(want, 0)
  UNION ALL SELECT 'duplicate_id', CAST(id AS VARCHAR), CAST(n AS VARCHAR) FROM d UNION ALL SELECT 'forbidden_text', CAST(doc_id AS VARCHAR), n FROM f WHERE n IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY key, detail) AS a FROM v)
SELECT "check", count(*) AS n, string_agg(CASE WHEN a <= 5 THEN key END, '|' ORDER BY key) AS examples FROM r GROUP BY 1""",
    ),
    "prediction_coverage": (
        _coverage,
        "SELECT covered, count(*) AS n FROM (SELECT conv_id, bool_or(role = 'system') AS covered FROM conversations GROUP BY 1) GROUP BY 1",
    ),
    "duplicate_rows": (_dups, "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1"),
    "block_norms": (
        _norms,
        """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT id, sqrt(list_dot_product(e, e)) AS l2, list_avg(list_transform(e, lambda x: abs(x))) AS m FROM v)
SELECT id, round(l2, 6) AS l2, round(m, 6) AS mean_abs, round(l2 / (SELECT max(l2) FROM n), 6) AS l2_share FROM n""",
    ),
    "cloud_summary": (
        _cloud,
        "WITH v AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) SELECT label, "
        + ", ".join(
            f"round(avg({a}), 6) AS {a}_mean, round(stddev_pop({a}), 6) AS {a}_std, round(min({a}), 6) AS {a}_min, round(max({a}), 6) AS {a}_max, round(quantile_cont({a}, 0.1), 6) AS {a}_p10, round(quantile_cont({a}, 0.5), 6) AS {a}_p50, round(quantile_cont({a}, 0.9), 6) AS {a}_p90"
            for a in "xyz"
        )
        + ", round(ln(1 + count(*)), 6) AS log_n FROM v GROUP BY 1",
    ),
}
