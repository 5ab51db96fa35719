"""The task contracts on the driver's tables, each with its target, split, fit and measures.

A user's events are an episode; a window's features are the temporal statistics of the signal
(motion) and of the counter k (vision and contacts). Vectors stand for samples with two views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.functions.lineage import landed
from windlass.operators import features, metrics, tasks
from windlass.operators import timeline as t
from windlass.plans import sql_heads
from windlass.plans.tables import SQL_BASE, SQL_MAJORITY, frames, vectors, windows

EPOCHS, ALPHA, SHIFT, AHEAD, FRAMES = 5, 3.0, 8, 4, 10
STATS = ["mean", "std", "min", "max", "delta", "vel_mean", "vel_std"]
LABELS = ["click", "purchase", "signup", "view"]
MOTION, VISION = len(STATS), len(STATS)


def _window_id():
    return (F.col("episode_id") * 1_000_000 + F.col("window_index")).alias("id")


def _features(s, d):
    """(episode_id, window_index, motion, vision) of every window."""
    f = frames(s, d)
    parts = []
    for value, name in (("signal", "motion"), ("k", "vision")):
        stats = features.temporal_stats(f.withColumn(value, F.col(value).cast("double")), value=value)
        parts.append(stats.select("episode_id", "window_index", F.array(*STATS).alias(name)))
    return landed(parts[0].join(parts[1], ["episode_id", "window_index"]))


def _task_rows(s, d, target, x=None):
    """The windows that have a target, split by time within their episode, with features x."""
    joined = t.chronological_split(target).join(_features(s, d), ["episode_id", "window_index"])
    return joined.select(_window_id(), "*", (F.concat("motion", "vision") if x is None else x).alias("x")).drop("motion", "vision")


def _action(s, d):
    return _task_rows(s, d, t.majority_label(frames(s, d), least=0.3).where("label is not null").select("episode_id", "window_index", "label"))


def _subtask(s, d):
    themes = frames(s, d).withColumn("label", F.when(F.col("k") < 90, F.concat(F.lit("theme"), F.floor(F.col("k") / 30).cast("string"))))
    return _task_rows(s, d, t.majority_label(themes, least=0.3).where("label is not null").select("episode_id", "window_index", "label"))


def _transition(s, d):
    near = t.near_boundary(windows(s, d), t.boundaries(frames(s, d)), 0)
    return _task_rows(s, d, near.select("episode_id", "window_index", "center_frame", F.when(F.col("transition") == 1, "transition").otherwise("steady").alias("label")))


def _transition_task(s, d):
    """Beside the usual measures, boundaries found within a frame of predicted windows' centers;
    the true ones are those between an episode's first and last test window."""
    scored, told = tasks.classify(_transition(s, d), epochs=EPOCHS)
    span = scored.groupBy("episode_id").agg(F.min("center_frame").alias("lo"), F.max("center_frame").alias("hi"))
    truth = t.boundaries(frames(s, d)).join(span, "episode_id").where("frame_idx between lo and hi").select("episode_id", "frame_idx").distinct()
    guess = scored.where("predicted_label = 'transition'").select("episode_id", F.col("center_frame").alias("frame_idx"))
    found = metrics.boundary_matches(truth, guess, 1).agg(F.sum("matched").alias("m"), F.sum("predicted").alias("p"), F.sum("true").alias("t"))
    return told.unionByName(tasks.measures(found.select((2 * F.col("m") / (F.col("p") + F.col("t"))).alias("boundary_f1"))))


def _next(s, d):
    return _task_rows(s, d, t.future_label(windows(s, d), frames(s, d)).select("episode_id", "window_index", F.col("next_label").alias("label")).where("label is not null"))


def _hands(s, d):
    """Two hands of one joint each, less the root: of each frame to come (signal, k and both's
    difference for the left; half of each for the right), less the signal of that frame."""
    joints = F.transform(F.array("signal", "k", F.col("signal") - F.col("k"), F.col("signal") / 2, F.col("k") / 2, F.lit(0.0)), lambda v: v - F.col("signal"))
    f = frames(s, d).select("episode_id", F.col("frame_idx").alias("_f"), joints.alias("joints"))
    asked = windows(s, d).select("episode_id", "window_index", F.explode(F.sequence(F.col("end_frame") + 1, F.col("end_frame") + FRAMES)).alias("_f"))
    ahead = asked.join(f, ["episode_id", "_f"]).groupBy("episode_id", "window_index").agg(F.count("*").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_f", "joints"))), lambda v: v["joints"])).alias("y"))
    return _task_rows(s, d, ahead.where(F.col("n") == FRAMES).drop("n"))


def _contact(s, d):
    flags = t.window_flags(frames(s, d).withColumn("contact", F.col("k") > 95))
    return _task_rows(s, d, flags.select("episode_id", "window_index", F.when(F.col("any_contact"), "contact").otherwise("no_contact").alias("label")), F.col("motion"))


def _objects(s, d):
    sets = t.object_sets(frames(s, d).withColumn("label", F.when(F.col("k") % 4 == 0, F.col("label"))))
    return _task_rows(s, d, sets.select("episode_id", "window_index", F.split("by_first_seen", r"\|").alias("true_set")))


def _views(left, right):
    def rows(s, d):
        v = vectors(s, d)
        cut = lambda part: F.slice("vector", part[0], part[1])
        return v.select("id", F.when(F.col("id") % 10 < 7, "train").otherwise("test").alias("split"), cut(left).alias("x"), cut(right).alias("y"))

    return rows


def _split_pairs(pairs):
    """Pairs in the order of their place, split within the episode as windows are."""
    return t.chronological_split(pairs.withColumnRenamed("place", "window_index"))


def _order(s, d):
    pairs = _split_pairs(t.order_pairs(windows(s, d)))
    held = _features(s, d).select("episode_id", "window_index", F.concat("motion", "vision").alias("v"))
    side = lambda name: held.select("episode_id", F.col("window_index").alias(name), F.col("v").alias(f"_{name}"))
    joined = pairs.join(side("first"), ["episode_id", "first"]).join(side("second"), ["episode_id", "second"])
    return joined.select(_window_id(), "split", F.col("in_order").alias("y"), tasks.pair_column("_first", "_second").alias("x"))


def _misaligned(s, d):
    later = F.col("first") + F.when(F.col("aligned") == 1, SHIFT).otherwise(0)
    pairs = t.alignment_pairs(windows(s, d), SHIFT)
    held = _features(s, d)
    last = held.groupBy("episode_id").agg(F.max("window_index").alias("_last"))
    pairs = pairs.join(last, "episode_id").where(later <= F.col("_last")).withColumn("place", 2 * F.col("first") + 1 - F.col("aligned"))
    split = _split_pairs(pairs)
    joined = split.join(held.select("episode_id", F.col("window_index").alias("first"), "motion"), ["episode_id", "first"]).join(held.select("episode_id", F.col("window_index").alias("second"), "vision"), ["episode_id", "second"])
    return joined.select(_window_id(), "split", F.col("aligned").alias("y"), F.concat("motion", "vision").alias("x"))


def _intensity(s, d):
    stats = features.temporal_stats(frames(s, d))
    high = t.above_train_median(t.chronological_split(t.motion_energy(stats, ["mean", "std"]).select("episode_id", "window_index", F.round("energy", 6).alias("energy"))))
    return _task_rows(s, d, high.select("episode_id", "window_index", F.col("is_high").alias("y")), F.col("vision"))


def _progress(s, d):
    """Progress at a window's center through runs of the themes of five frames."""
    themed = frames(s, d).withColumn("label", F.floor(F.col("frame_idx") / 7).cast("string"))
    done = t.run_progress(themed).select("episode_id", F.col("frame_idx").alias("center_frame"), "progress")
    return _task_rows(s, d, windows(s, d).join(done, ["episode_id", "center_frame"]).select("episode_id", "window_index", F.array("progress").alias("y")))


def _ego(s, d):
    held = _features(s, d)
    later = held.select("episode_id", (F.col("window_index") - AHEAD).alias("window_index"), F.col("motion").alias("_later"))
    moved = held.join(later, ["episode_id", "window_index"]).select("episode_id", "window_index", F.zip_with("_later", "motion", lambda a, b: a - b).alias("y"))
    return _task_rows(s, d, moved)


_LEFT, _RIGHT, _TEXT = (1, 24), (25, 16), (41, 24)
#: The runs of the contracts, by name: each gives rows (metric, value).
TASKS = {
    "timeline_action": lambda s, d: tasks.classify(_action(s, d), epochs=EPOCHS)[1],
    "timeline_subtask": lambda s, d: tasks.classify(_subtask(s, d), epochs=EPOCHS)[1],
    "transition_detection": _transition_task,
    "next_action": lambda s, d: tasks.classify(_next(s, d), epochs=EPOCHS)[1],
    "hand_trajectory_forecast": lambda s, d: tasks.regress(_hands(s, d), ALPHA, points=(FRAMES, 2)),
    "contact_prediction": lambda s, d: tasks.classify(_contact(s, d), epochs=EPOCHS)[1],
    "object_relevance": lambda s, d: tasks.relevant(_objects(s, d), LABELS, epochs=EPOCHS),
    "caption_grounding": lambda s, d: tasks.retrieve(_views((1, 40), _TEXT)(s, d), ALPHA, by_target=True),
    "cross_modal_retrieval": lambda s, d: tasks.retrieve(_views(_LEFT, _RIGHT)(s, d), ALPHA),
    "modality_reconstruction": lambda s, d: tasks.regress(_views(_LEFT, _RIGHT)(s, d), ALPHA),
    "temporal_order": lambda s, d: tasks.decide(_order(s, d), epochs=EPOCHS),
    "misalignment_detection": lambda s, d: tasks.decide(_misaligned(s, d), epochs=EPOCHS),
    "body_motion_intensity": lambda s, d: tasks.ridge_decide(_intensity(s, d), alpha=ALPHA),
    "multi_view_consistency_retrieval": lambda s, d: tasks.retrieve(_views((1, 32), (33, 32))(s, d), ALPHA),
    "action_phase_progress": lambda s, d: tasks.regress(_progress(s, d), ALPHA, low=0.0, high=1.0),
    "ego_motion_forecast": lambda s, d: tasks.regress(_ego(s, d), ALPHA),
}

_STATS_OF = lambda v: f"""stats_{v} AS (SELECT episode_id, window_index, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, round(min({v}), 6) AS min, round(max({v}), 6) AS max,
  round(arg_max({v}, frame_idx) - arg_min({v}, frame_idx), 6) AS delta, round(avg(dv), 6) AS vel_mean, round(stddev_pop(dv), 6) AS vel_std
  FROM (SELECT *, {v} - lag({v}) OVER (PARTITION BY episode_id, window_index ORDER BY frame_idx) AS dv FROM members) GROUP BY 1, 2)"""  # noqa: E731
SQL_FEATURES = (
    SQL_BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""",
{_STATS_OF("signal")},
{_STATS_OF("k")},
feats AS MATERIALIZED (SELECT a.episode_id, a.window_index, [{", ".join("a." + c for c in STATS)}]::DOUBLE[] AS motion, [{", ".join("b." + c for c in STATS)}]::DOUBLE[] AS vision
  FROM stats_signal a JOIN stats_k b USING (episode_id, window_index))"""
)


def _sql_rows(target: str, x: str = "list_concat(motion, vision)", columns: str = "label") -> str:
    """``rows`` of ``target`` (episode_id, window_index, columns), split by time in the episode."""
    return f"""target AS ({target}),
placed AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY window_index) <= greatest(1, least(round_even(count(*) OVER (PARTITION BY episode_id) * (1 - 0.3), 0), count(*) OVER (PARTITION BY episode_id) - 1)) AS train FROM target),
named AS MATERIALIZED (SELECT p.episode_id * 1000000 + p.window_index AS id, p.*, {x} AS x FROM placed p JOIN feats USING (episode_id, window_index))"""


def _sql_classes(target: str, classes: int, x: str = "list_concat(motion, vision)", width: int = MOTION + VISION, more: str = "") -> str:
    last = f"""train_p AS (SELECT id, arg_max(c, (l, -c)) AS c FROM l{EPOCHS - 1} GROUP BY id),
told AS (SELECT y AS a, predicted AS b FROM scored),
by_class AS (SELECT c, count(*) FILTER (a = c) AS t, count(*) FILTER (b = c) AS p, count(*) FILTER (a = c AND b = c) AS h FROM told, (SELECT DISTINCT y AS c FROM rows) GROUP BY c),
out AS (SELECT
  (SELECT count(*) FROM rows WHERE train)::DOUBLE AS num_train, (SELECT count(*) FROM rows WHERE NOT train)::DOUBLE AS num_test, (SELECT count(DISTINCT y) FROM rows)::DOUBLE AS num_classes,
  (SELECT avg(CAST(a = b AS INTEGER)) FROM told) AS accuracy, (SELECT avg(CASE WHEN t + p > 0 THEN 2.0 * h / (t + p) ELSE 0 END) FROM by_class WHERE t > 0) AS macro_f1,
  (SELECT avg(CAST(y = (SELECT y FROM rows WHERE train GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) AS INTEGER)) FROM rows WHERE NOT train) AS majority_baseline_accuracy,
  (SELECT count(DISTINCT y) FROM rows WHERE NOT train AND y NOT IN (SELECT y FROM rows WHERE train))::DOUBLE AS unseen_test_classes,
  (SELECT avg(CAST(c = y AS INTEGER)) FROM train_p JOIN rows USING (id)) AS train_final_accuracy{more})
SELECT metric, round(value, 6) AS value FROM (UNPIVOT out ON COLUMNS(*) INTO NAME metric VALUE value)"""
    return f"""{SQL_FEATURES}{SQL_MAJORITY},
{_sql_rows(target, x)},
rows AS MATERIALIZED (SELECT *, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y FROM named),
{sql_heads.softmax(width, classes, EPOCHS)},
{last}"""


def _sql_decide(rows: str, width: int) -> str:
    return f"""{SQL_FEATURES},
{rows},
{sql_heads.softmax(width, 2, EPOCHS)},
n AS (SELECT count(*) FILTER (y = 1 AND predicted = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND predicted = 0)::DOUBLE AS tn, count(*) FILTER (y = 0 AND predicted = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND predicted = 0)::DOUBLE AS fn FROM scored),
out AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  (tp + fn) / (tp + tn + fp + fn) AS true_rate, (tp + fp) / (tp + tn + fp + fn) AS predicted_rate FROM n)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT out ON COLUMNS(*) INTO NAME metric VALUE value)"""


def _sql_regress(head: str, rows: str, width: int, targets: int, clip: str = "p", more: str = "", points: str = "") -> str:
    return f"""{head},
{rows},
{sql_heads.ridge(width, targets, ALPHA)},
flat AS MATERIALIZED (SELECT id, k, t_0.v AS t, {clip} AS p FROM scored JOIN t_0 USING (id, k)),
sums AS (SELECT k, count(*) AS n, sum(t) AS s, sum(t * t) AS ss, sum((t - p) ** 2) AS e, sum(abs(t - p)) AS a FROM flat GROUP BY k){points},
out AS (SELECT sum(e) / sum(n) AS mse, sum(a) / sum(n) AS mae, 1 - sum(e) / sum(ss - s * s / n) AS r2{more} FROM sums)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT out ON COLUMNS(*) INTO NAME metric VALUE value)"""


def _sql_view_rows(left, right) -> str:
    part = lambda p: f"embedding[{p[0]}:{p[0] + p[1] - 1}]::DOUBLE[]"
    return f"rows AS MATERIALIZED (SELECT vec_id AS id, vec_id % 10 < 7 AS train, {part(left)} AS x, {part(right)} AS y FROM embeddings)"


def _sql_retrieve(left, right, by_target: bool = False) -> str:
    a, b = ("t", "p") if by_target else ("p", "t")
    return f"""WITH RECURSIVE {_sql_view_rows(left, right)},
{sql_heads.ridge(left[1], right[1], ALPHA)},
pairs AS MATERIALIZED (SELECT id, list(t_0.v ORDER BY k) AS t, list(p ORDER BY k) AS p FROM scored JOIN t_0 USING (id, k) GROUP BY id),
cos AS MATERIALIZED (SELECT q.id, c.id AS c, list_cosine_similarity(q.{a}, c.{b}) AS v FROM pairs q, pairs c),
ranks AS (SELECT x.id, 1 + count(*) FILTER (y.v > x.v + 1e-12 OR (abs(y.v - x.v) <= 1e-12 AND y.c < x.c)) AS r FROM cos x JOIN cos y ON y.id = x.id WHERE x.c = x.id GROUP BY x.id),
out AS (SELECT count(*)::DOUBLE AS n, avg(1.0 / r) AS mrr, avg(r)::DOUBLE AS mean_rank, avg(CAST(r <= 1 AS INTEGER))::DOUBLE AS top_1, avg(CAST(r <= 5 AS INTEGER))::DOUBLE AS top_5, avg(CAST(r <= 10 AS INTEGER))::DOUBLE AS top_10, median(r)::DOUBLE AS median_rank FROM ranks)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT out ON COLUMNS(*) INTO NAME metric VALUE value)"""


_MAJORITY_TARGET = "SELECT episode_id, window_index, label FROM majority WHERE label IS NOT NULL"
_THEME = """SELECT episode_id, window_index, label FROM (
  SELECT episode_id, window_index, l AS label, c, row_number() OVER (PARTITION BY episode_id, window_index ORDER BY c DESC, f) AS r, sum(c) OVER (PARTITION BY episode_id, window_index) AS total
  FROM (SELECT episode_id, window_index, CASE WHEN k < 90 THEN 'theme' || (k // 30) END AS l, count(*) AS c, min(frame_idx) AS f FROM members GROUP BY 1, 2, 3) WHERE l IS NOT NULL) WHERE r = 1 AND c / total >= 0.3"""
_BOUNDS = "(SELECT episode_id, frame_idx FROM (SELECT *, lag(label) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS before FROM frames) WHERE label IS NOT NULL AND before IS NOT NULL AND label <> before)"
_TRANSITION = f"SELECT w.episode_id, w.window_index, w.center_frame, CASE WHEN EXISTS (SELECT 1 FROM {_BOUNDS} b WHERE b.episode_id = w.episode_id AND b.frame_idx = w.center_frame) THEN 'transition' ELSE 'steady' END AS label FROM windows w"
_NEXT = "SELECT w.episode_id, w.window_index, f.label FROM windows w JOIN lens l USING (episode_id) JOIN frames f ON f.episode_id = w.episode_id AND f.frame_idx = least(l.n - 1, w.end_frame + 20) WHERE f.label IS NOT NULL"
_CONTACT = "SELECT episode_id, window_index, CASE WHEN bool_or(k > 95) THEN 'contact' ELSE 'no_contact' END AS label FROM members GROUP BY 1, 2"
_HANDS = f"""SELECT w.episode_id, w.window_index, flatten(list([signal - signal, k - signal, signal - k - signal, signal / 2 - signal, k / 2 - signal, 0.0 - signal] ORDER BY f.frame_idx)) AS y
  FROM windows w JOIN frames f ON f.episode_id = w.episode_id AND f.frame_idx BETWEEN w.end_frame + 1 AND w.end_frame + {FRAMES} GROUP BY 1, 2 HAVING count(*) = {FRAMES}"""
_PROGRESS = """SELECT w.episode_id, w.window_index, [CASE WHEN m > 1 THEN i / (m - 1) ELSE 0.0 END] AS y FROM windows w JOIN (
  SELECT episode_id, frame_idx, frame_idx % 7 AS i, count(*) OVER (PARTITION BY episode_id, frame_idx // 7) AS m FROM frames) p ON p.episode_id = w.episode_id AND p.frame_idx = w.center_frame"""
_EGO = f"SELECT a.episode_id, a.window_index, list_transform(range(1, {MOTION + 1}), lambda j: b.motion[j] - a.motion[j]) AS y FROM feats a JOIN feats b ON b.episode_id = a.episode_id AND b.window_index = a.window_index + {AHEAD}"
_OBJECTS = "SELECT episode_id, window_index, [" + ", ".join(f"CAST(bool_or(label IS NOT DISTINCT FROM '{x}' AND k % 4 = 0) AS INTEGER)" for x in LABELS) + "] AS y FROM members GROUP BY 1, 2 HAVING count(label) FILTER (k % 4 = 0) > 0"
_ORDER = f"""pairs AS (SELECT episode_id, window_index AS a, lead(window_index) OVER (PARTITION BY episode_id ORDER BY window_index) AS b FROM windows),
target AS (SELECT episode_id, 2 * a AS window_index, a AS first, b AS second, 1 AS y FROM pairs WHERE b IS NOT NULL UNION ALL SELECT episode_id, 2 * a + 1, b, a, 0 FROM pairs WHERE b IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY window_index) <= greatest(1, least(round_even(count(*) OVER (PARTITION BY episode_id) * (1 - 0.3), 0), count(*) OVER (PARTITION BY episode_id) - 1)) AS train FROM target),
sides AS (SELECT episode_id, window_index, list_concat(motion, vision) AS v FROM feats),
rows AS MATERIALIZED (SELECT p.episode_id * 1000000 + p.window_index AS id, train, y, list_concat(list_concat(f.v, g.v), list_transform(range(1, {MOTION + VISION + 1}), lambda j: g.v[j] - f.v[j])) AS x
  FROM placed p JOIN sides f ON f.episode_id = p.episode_id AND f.window_index = p.first JOIN sides g ON g.episode_id = p.episode_id AND g.window_index = p.second)"""
_MISALIGNED = f"""target AS (SELECT a.episode_id, 2 * a.window_index + 1 - y AS window_index, a.window_index AS first, a.window_index + (1 - y) * {SHIFT} AS second, y FROM windows a JOIN windows b ON b.episode_id = a.episode_id AND b.window_index = a.window_index + {SHIFT}, (VALUES (1), (0)) s(y)),
placed AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY window_index) <= greatest(1, least(round_even(count(*) OVER (PARTITION BY episode_id) * (1 - 0.3), 0), count(*) OVER (PARTITION BY episode_id) - 1)) AS train FROM target),
rows AS MATERIALIZED (SELECT p.episode_id * 1000000 + p.window_index AS id, train, y, list_concat(f.motion, g.vision) AS x FROM placed p JOIN feats f ON f.episode_id = p.episode_id AND f.window_index = p.first JOIN feats g ON g.episode_id = p.episode_id AND g.window_index = p.second)"""
_HIGH = """SELECT episode_id, window_index, CAST(energy >= (SELECT quantile_cont(energy, 0.5) FROM e WHERE train) AS INTEGER) AS y FROM e"""
_ENERGY = """e AS MATERIALIZED (SELECT *, row_number() OVER w <= greatest(1, least(round_even(count(*) OVER (PARTITION BY episode_id) * (1 - 0.3), 0), count(*) OVER (PARTITION BY episode_id) - 1)) AS train FROM (
  SELECT episode_id, window_index, round(coalesce(sqrt(pow(motion[1] - lag(motion[1]) OVER v, 2) + pow(motion[2] - lag(motion[2]) OVER v, 2)), 0.0), 6) AS energy FROM feats WINDOW v AS (PARTITION BY episode_id ORDER BY window_index)) WINDOW w AS (PARTITION BY episode_id ORDER BY window_index))"""
_ROWS = "rows AS MATERIALIZED (SELECT id, train, x, y FROM named)"
_BOUNDARY_F1 = f""", (WITH RECURSIVE span AS (SELECT episode_id, min(center_frame) AS lo, max(center_frame) AS hi FROM named WHERE NOT train GROUP BY 1),
  tr AS (SELECT b.episode_id, list(DISTINCT frame_idx) AS ts FROM {_BOUNDS} b JOIN span USING (episode_id) WHERE frame_idx BETWEEN lo AND hi GROUP BY 1),
  gu AS (SELECT episode_id, list_sort(list(center_frame)) AS gs FROM scored JOIN named USING (id) WHERE predicted = 1 GROUP BY 1),
  a AS (SELECT coalesce(tr.episode_id, gu.episode_id) AS episode_id, coalesce(ts, []) AS ts, coalesce(gs, []) AS gs FROM tr FULL JOIN gu ON gu.episode_id = tr.episode_id),
  m AS (SELECT episode_id, ts, gs, 1 AS i, []::BIGINT[] AS used FROM a
    UNION ALL SELECT episode_id, ts, gs, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.t) END
    FROM (SELECT *, list_sort(list_transform(list_filter(ts, lambda x: abs(x - gs[i]) <= 1 AND NOT list_contains(used, x)), lambda x: struct_pack(g := abs(x - gs[i]), t := x)))[1] AS best FROM m WHERE i <= len(gs)))
  SELECT 2.0 * sum(len(used)) / (sum(len(gs)) + sum(len(ts))) FROM m WHERE i = len(gs) + 1) AS boundary_f1"""
_WIDTH = MOTION + VISION
_WINDOW_HEAD = SQL_FEATURES
_RELEVANT = f"""{SQL_FEATURES},
{_sql_rows(_OBJECTS)},
{_ROWS},
{sql_heads.multilabel(_WIDTH, len(LABELS), EPOCHS)},
told AS MATERIALIZED (SELECT id, c, y_0.t > 0 AS t, on_ AS p FROM scored JOIN y_0 USING (id, c)),
n AS (SELECT c, count(*) FILTER (t AND p)::DOUBLE AS tp, count(*) FILTER (p AND NOT t)::DOUBLE AS fp, count(*) FILTER (t AND NOT p)::DOUBLE AS fn FROM told GROUP BY c),
out AS (SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1, (SELECT avg(CAST(ok AS INTEGER)) FROM (SELECT bool_and(t = p) AS ok FROM told GROUP BY id)) AS exact_match FROM n)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT out ON COLUMNS(*) INTO NAME metric VALUE value)"""
_INTENSITY = f"""{SQL_FEATURES},
{_ENERGY},
{_sql_rows(_HIGH, "vision")},
rows AS MATERIALIZED (SELECT id, train, x, y AS label, [CAST(y = 0 AS DOUBLE), CAST(y = 1 AS DOUBLE)] AS y FROM named),
{sql_heads.ridge(VISION, 2, ALPHA, False)},
told AS (SELECT id, any_value(label) AS t, arg_max(k - 1, (p, -k)) AS p FROM scored JOIN rows USING (id) GROUP BY id),
by_class AS (SELECT c, count(*) FILTER (t = c)::DOUBLE AS t, count(*) FILTER (p = c)::DOUBLE AS p, count(*) FILTER (t = c AND p = c)::DOUBLE AS h FROM told, (VALUES (0), (1)) v(c) GROUP BY c),
out AS (SELECT (SELECT avg(CAST(t = p AS INTEGER)) FROM told)::DOUBLE AS accuracy, max(CASE WHEN c = 1 THEN coalesce(2 * h / nullif(t + p, 0), 0) END) AS f1, sum(coalesce(2 * h / nullif(t + p, 0), 0)) / 2 AS macro_f1 FROM by_class)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT out ON COLUMNS(*) INTO NAME metric VALUE value)"""
_POINTS = f""",
gaps AS (SELECT id, (k - 1) // 3 AS point, sqrt(sum((t - p) ** 2)) AS gap FROM flat GROUP BY 1, 2)"""
SQL = {
    "timeline_action": _sql_classes(_MAJORITY_TARGET, 4),
    "timeline_subtask": _sql_classes(_THEME, 3),
    "transition_detection": _sql_classes(_TRANSITION, 2, more=_BOUNDARY_F1),
    "next_action": _sql_classes(_NEXT, 4),
    "hand_trajectory_forecast": _sql_regress(_WINDOW_HEAD, f"{_sql_rows(_HANDS)},\n{_ROWS}", _WIDTH, 6 * FRAMES, points=_POINTS, more=f", (SELECT avg(gap) FROM gaps) AS mpjpe, (SELECT avg(gap) FROM gaps WHERE point >= {2 * (FRAMES - 1)}) AS final_frame_mpjpe"),
    "contact_prediction": _sql_classes(_CONTACT, 2, "motion", MOTION),
    "object_relevance": _RELEVANT,
    "caption_grounding": _sql_retrieve((1, 40), _TEXT, True),
    "cross_modal_retrieval": _sql_retrieve(_LEFT, _RIGHT),
    "modality_reconstruction": _sql_regress(f"WITH RECURSIVE {_sql_view_rows(_LEFT, _RIGHT)}", "one AS (SELECT 1)", _LEFT[1], _RIGHT[1]),
    "temporal_order": _sql_decide(_ORDER, 3 * _WIDTH),
    "misalignment_detection": _sql_decide(_MISALIGNED, _WIDTH),
    "body_motion_intensity": _INTENSITY,
    "multi_view_consistency_retrieval": _sql_retrieve((1, 32), (33, 32)),
    "action_phase_progress": _sql_regress(_WINDOW_HEAD, f"{_sql_rows(_PROGRESS)},\n{_ROWS}", _WIDTH, 1, clip="greatest(0.0, least(1.0, p))"),
    "ego_motion_forecast": _sql_regress(_WINDOW_HEAD, f"{_sql_rows(_EGO)},\n{_ROWS}", _WIDTH, MOTION),
}


def _query(run):
    return lambda s, d: run(s, d).select("metric", F.round("value", 6).alias("value"))


QUERIES = {f"task_{name}": (_query(run), SQL[name]) for name, run in TASKS.items()}


def task_suite(s, d):
    """All contracts as one table, failures as rows."""
    made = tasks.suite(s, {name: (lambda run=run: run(s, d)) for name, run in TASKS.items()})
    return made.withColumn("value", F.round("value", 6))
