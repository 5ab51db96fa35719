"""Timeline, label, feature and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.operators import features, joins, selection
from windlass.operators import timeline as t
from windlass.plans.tables import SQL_BASE, SQL_FRAMES, SQL_MAJORITY, frames, sql_windows, windows

SCALES = [("dense_20f_stride10", 20, 10), ("medium_40f_stride20", 40, 20), ("long_80f_stride40", 80, 40)]


def _majority(s, d):
    return t.majority_label(frames(s, d), least=0.3)


def _labelled(s, d):
    """Windows that have a majority label, with their split."""
    return t.chronological_split(_majority(s, d).where("label is not null"))


SQL_SPLIT = (
    SQL_BASE
    + SQL_MAJORITY
    + """,
labelled AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY episode_id ORDER BY window_index)
                  > greatest(1, least(round_even(count(*) OVER (PARTITION BY episode_id) * (1 - 0.3), 0), count(*) OVER (PARTITION BY episode_id) - 1))
                 THEN 'test' ELSE 'train' END AS split
  FROM majority WHERE label IS NOT NULL)"""
)


def _scaled(s, d):
    return t.multiscale_windows(t.episode_lengths(frames(s, d)), SCALES)


def _dense(s, d):
    dense = windows(s, d, 20, 5)
    sparse = windows(s, d, 20, 20)
    return joins.nearest_window(dense, sparse)


def _motion(s, d):
    stats = features.temporal_stats(frames(s, d))
    moved = t.motion_energy(stats, ["mean", "std"]).select("episode_id", "window_index", F.round("energy", 6).alias("energy"))
    return t.above_train_median(t.chronological_split(moved))


def _forecast(s, d):
    made = t.forecast_targets(frames(s, d), windows(s, d))
    return made.select("episode_id", "window_index", F.round(F.element_at("target", -1), 6).alias("last_step"), F.size("target").cast("long").alias("steps"))


def _stress(s, d):
    stats = features.temporal_stats(frames(s, d)).select("episode_id", "window_index", F.col("mean").alias("x"))
    return t.shift_stress(stats, [-8, -4, -2, -1, 0, 1, 2, 4, 8])


def _imu(s, d):
    """Windows joined with samples of a faster clock by keyframe bounds."""
    f = frames(s, d)
    samples = f.select("episode_id", F.explode(F.array(F.col("frame_idx") * 3, F.col("frame_idx") * 3 + 1, F.col("frame_idx") * 3 + 2)).alias("sample"), "signal")
    spans = windows(s, d).select("episode_id", "window_index", (F.col("start_frame") * 3).alias("lo"), (F.col("end_frame") * 3 + 1).alias("hi"))
    met = joins.in_range(spans, samples, "episode_id", "lo", "hi", "sample")
    return met.groupBy("episode_id", "window_index").agg(F.count("*").alias("samples"), F.round(F.avg("signal"), 6).alias("mean"))


def _asof(s, d):
    f = frames(s, d)
    poses = f.where("frame_idx % 10 = 0").select("episode_id", F.col("frame_idx").alias("at"), F.col("frame_idx").alias("pose_frame"))
    return joins.asof_forward(f.select("episode_id", F.col("frame_idx").alias("at")), poses, "episode_id", "at", "pose_frame")


def _spans(s, d):
    f = frames(s, d)
    return t.context_span(windows(s, d), t.episode_lengths(f), 40)


def _unseen(s, d):
    rows = _labelled(s, d).withColumn("label", F.concat_ws("/", "label", F.col("episode_id") % 40))
    return joins.unseen(rows.where("split = 'test'"), rows.where("split = 'train'"))


def _codes(s, d):
    rows = _labelled(s, d).withColumn("place", F.col("episode_id") * 1000 + F.col("window_index"))
    return selection.encode_first_seen(rows, "label", "place", "split")


QUERIES = {
    "sliding_window_majority_label": (_majority, SQL_BASE + SQL_MAJORITY + " SELECT * FROM majority"),
    "sliding_windows": (windows, f"WITH {SQL_FRAMES}, {sql_windows()} SELECT * FROM windows"),
    "multiscale_windows": (
        _scaled,
        f"WITH {SQL_FRAMES}, "
        + ", ".join(sql_windows(f"w{k}", w, st) for k, (_, w, st) in enumerate(SCALES))
        + " "
        + " UNION ALL ".join(
            f"SELECT episode_id, '{a}' AS scale_id, window_index, start_frame, end_frame, FALSE AS skipped FROM w{k} UNION ALL SELECT episode_id, '{a}', NULL, NULL, NULL, TRUE FROM lens WHERE n < {w}"
            for k, (a, w, _) in enumerate(SCALES)
        ),
    ),
    "window_count_estimate": (
        lambda s, d: t.window_estimate(t.episode_lengths(frames(s, d)), 20, 5),
        f"WITH {SQL_FRAMES} SELECT episode_id, n, CASE WHEN n >= 20 THEN (n - 20) // 5 + 1 ELSE 0 END AS n_windows FROM lens",
    ),
    "window_temporal_stats": (
        lambda s, d: features.temporal_stats(frames(s, d)),
        SQL_BASE
        + """, stepped AS (SELECT *, signal - lag(signal) OVER (PARTITION BY episode_id, window_index ORDER BY frame_idx) AS dv FROM members)
SELECT episode_id, window_index, round(avg(signal), 6) AS mean, round(stddev_pop(signal), 6) AS std, round(min(signal), 6) AS min, round(max(signal), 6) AS max,
  round(arg_max(signal, frame_idx) - arg_min(signal, frame_idx), 6) AS delta, round(avg(dv), 6) AS vel_mean, round(stddev_pop(dv), 6) AS vel_std
FROM stepped GROUP BY 1, 2""",
    ),
    "window_flags": (
        lambda s, d: t.window_flags(frames(s, d).withColumn("contact", F.col("k") > 95)),
        SQL_BASE + " SELECT episode_id, window_index, bool_or(k > 95) AS any_contact, count(DISTINCT label) > 1 AS transition FROM members GROUP BY 1, 2",
    ),
    "window_object_sets": (
        lambda s, d: t.object_sets(frames(s, d)),
        SQL_BASE
        + """, c AS (SELECT episode_id, window_index, label, count(*) AS c, min(frame_idx) AS f FROM members WHERE label IS NOT NULL GROUP BY 1, 2, 3)
SELECT episode_id, window_index, string_agg(label, '|' ORDER BY f) AS by_first_seen, string_agg(label, '|' ORDER BY c DESC, f) AS by_frequency FROM c GROUP BY 1, 2""",
    ),
    "action_boundaries": (
        lambda s, d: t.boundaries(frames(s, d)),
        f"""WITH {SQL_FRAMES}, b AS (SELECT *, lag(label) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS from_label FROM frames)
SELECT episode_id, frame_idx, from_label, label AS to_label FROM b WHERE label IS NOT NULL AND from_label IS NOT NULL AND label <> from_label""",
    ),
    "label_runs": (
        lambda s, d: t.label_runs(frames(s, d)),
        f"""WITH {SQL_FRAMES}, m AS (SELECT *, CASE WHEN frame_idx > 0 AND lag(label) OVER (PARTITION BY episode_id ORDER BY frame_idx) IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS c FROM frames),
r AS (SELECT *, sum(c) OVER (PARTITION BY episode_id ORDER BY frame_idx) - 1 AS run FROM m)
SELECT episode_id, CAST(run AS BIGINT) AS run_index, min(label) AS label, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS frames FROM r GROUP BY episode_id, run""",
    ),
    "run_progress": (
        lambda s, d: t.run_progress(frames(s, d)),
        f"""WITH {SQL_FRAMES}, m AS (SELECT *, CASE WHEN frame_idx > 0 AND lag(label) OVER (PARTITION BY episode_id ORDER BY frame_idx) IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS c FROM frames),
r AS (SELECT *, sum(c) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS run FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY episode_id, run ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY episode_id, run) AS n FROM r)
SELECT episode_id, frame_idx, round(CASE WHEN n > 1 THEN i / (n - 1) ELSE 0.0 END, 6) AS progress FROM p""",
    ),
    "next_action_clamped": (
        lambda s, d: t.future_label(windows(s, d), frames(s, d)),
        f"""WITH {SQL_FRAMES}, {sql_windows()}
SELECT w.episode_id, w.window_index, f.frame_idx AS target_frame, f.label AS next_label
FROM windows w JOIN lens l USING (episode_id) JOIN frames f ON f.episode_id = w.episode_id AND f.frame_idx = least(l.n - 1, w.end_frame + 20)""",
    ),
    "next_window_majority": (
        lambda s, d: t.next_window(_majority(s, d), 4),
        SQL_BASE
        + SQL_MAJORITY
        + """, n AS (SELECT *, lead(window_index, 4) OVER w AS future_index, lead(start_frame, 4) OVER w AS future_start, lead(label, 4) OVER w AS future_label FROM majority WINDOW w AS (PARTITION BY episode_id ORDER BY start_frame))
SELECT episode_id, window_index, label, future_index, future_start, future_label FROM n WHERE future_index IS NOT NULL""",
    ),
    "transition_near_boundary": (
        lambda s, d: t.near_boundary(windows(s, d), t.boundaries(frames(s, d)), 1).select("episode_id", "window_index", "center_frame", "transition"),
        f"""WITH {SQL_FRAMES}, {sql_windows()}, b AS (SELECT *, lag(label) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS p FROM frames)
SELECT episode_id, window_index, center_frame, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.episode_id = w.episode_id AND b.label <> b.p AND abs(b.frame_idx - w.center_frame) <= 1) THEN 1 ELSE 0 END AS transition FROM windows w""",
    ),
    "temporal_order_pairs": (
        lambda s, d: t.order_pairs(windows(s, d)),
        f"""WITH {SQL_FRAMES}, {sql_windows()}, p AS (SELECT episode_id, window_index AS a, lead(window_index) OVER (PARTITION BY episode_id ORDER BY window_index) AS b FROM windows)
SELECT episode_id, 2 * a AS place, a AS first, b AS second, 1 AS in_order FROM p WHERE b IS NOT NULL UNION ALL SELECT episode_id, 2 * a + 1, b, a, 0 FROM p WHERE b IS NOT NULL""",
    ),
    "temporal_coin_pairs": (
        lambda s, d: t.coin_pairs(windows(s, d)),
        f"""WITH {SQL_FRAMES}, {sql_windows()}, p AS (SELECT episode_id, window_index AS a, lead(window_index) OVER (PARTITION BY episode_id ORDER BY window_index) AS b FROM windows),
c AS (SELECT *, CAST(('0x' || substr(sha256('pairs:' || episode_id || ':' || a), 1, 4)) AS BIGINT) % 2 AS o FROM p WHERE b IS NOT NULL)
SELECT episode_id, CASE WHEN o = 1 THEN a ELSE b END AS first, CASE WHEN o = 1 THEN b ELSE a END AS second, CAST(o AS INTEGER) AS in_order FROM c""",
    ),
    "misaligned_pairs": (
        lambda s, d: t.alignment_pairs(windows(s, d), 8),
        f"""WITH {SQL_FRAMES}, {sql_windows()} SELECT episode_id, window_index AS first, window_index AS second, 1 AS aligned FROM windows
UNION ALL SELECT a.episode_id, a.window_index, b.window_index, 0 FROM windows a JOIN windows b ON a.episode_id = b.episode_id AND b.window_index = a.window_index + 8""",
    ),
    "alignment_stress": (
        _stress,
        SQL_BASE
        + """, x AS (SELECT episode_id, window_index, round(avg(signal), 6) AS x FROM members GROUP BY 1, 2), s AS (SELECT unnest([-8, -4, -2, -1, 0, 1, 2, 4, 8])::BIGINT AS shift)
SELECT shift, count(*) AS pairs, round(avg(abs(b.x - a.x)), 6) AS mean_abs_diff FROM x a CROSS JOIN s JOIN x b ON b.episode_id = a.episode_id AND b.window_index = a.window_index + shift GROUP BY 1""",
    ),
    "context_span": (
        _spans,
        f"""WITH {SQL_FRAMES}, {sql_windows()}, c AS (SELECT w.*, n, greatest(0, least(center_frame - 20, n - 40)) AS lo FROM windows w JOIN lens USING (episode_id))
SELECT episode_id, window_index, lo AS context_start, least(n, lo + 40) - 1 AS context_end FROM c""",
    ),
    "chronological_split": (
        lambda s, d: _labelled(s, d).select("episode_id", "window_index", "label", "split"),
        SQL_SPLIT + " SELECT episode_id, window_index, label, split FROM labelled",
    ),
    "unseen_test_labels": (
        _unseen,
        SQL_SPLIT + ", l AS (SELECT label || '/' || (episode_id % 40) AS label, split FROM labelled) SELECT DISTINCT label FROM l WHERE split = 'test' AND label NOT IN (SELECT label FROM l WHERE split = 'train')",
    ),
    "train_first_encode": (
        _codes,
        SQL_SPLIT
        + """, k AS (SELECT label, min(CASE WHEN split = 'train' THEN 0 ELSE 1 END) AS t, min(CASE WHEN split = 'train' THEN episode_id * 1000 + window_index END) AS f, min(episode_id * 1000 + window_index) AS o FROM labelled GROUP BY 1)
SELECT label, row_number() OVER (ORDER BY t, coalesce(f, o)) - 1 AS code FROM k""",
    ),
    "even_downsample": (
        lambda s, d: t.even_sample(frames(s, d), 12).select("episode_id", "frame_idx"),
        f"WITH {SQL_FRAMES} SELECT DISTINCT episode_id, frame_idx FROM frames JOIN lens USING (episode_id) WHERE n <= 12 OR frame_idx IN (SELECT CAST(floor(i * (n - 1) / 11) AS BIGINT) FROM range(12) r(i))",
    ),
    "motion_energy_high": (
        _motion,
        SQL_BASE
        + """, x AS (SELECT episode_id, window_index, round(avg(signal), 6) AS a, round(stddev_pop(signal), 6) AS b FROM members GROUP BY 1, 2),
e AS (SELECT *, round(coalesce(sqrt(pow(a - lag(a) OVER w, 2) + pow(b - lag(b) OVER w, 2)), 0.0), 6) AS energy,
  CASE WHEN row_number() OVER w > greatest(1, least(round_even(count(*) OVER (PARTITION BY episode_id) * (1 - 0.3), 0), count(*) OVER (PARTITION BY episode_id) - 1)) THEN 'test' ELSE 'train' END AS split
  FROM x WINDOW w AS (PARTITION BY episode_id ORDER BY window_index))
SELECT episode_id, window_index, energy, split, CAST(energy >= (SELECT quantile_cont(energy, 0.5) FROM e WHERE split = 'train') AS INTEGER) AS is_high FROM e""",
    ),
    "forecast_targets": (
        _forecast,
        f"""WITH {SQL_FRAMES}, {sql_windows()}
SELECT w.episode_id, w.window_index, round(arg_max(signal, f.frame_idx) - arg_min(signal, f.frame_idx), 6) AS last_step, count(*) AS steps
FROM windows w JOIN frames f ON f.episode_id = w.episode_id AND f.frame_idx BETWEEN w.end_frame + 1 AND w.end_frame + 10 GROUP BY 1, 2 HAVING count(*) = 10""",
    ),
    "dense_nearest_source": (
        _dense,
        f"""WITH {SQL_FRAMES}, {sql_windows()}, {sql_windows("sparse", 20, 20)},
m AS (SELECT d.*, s.window_index AS source_index, s.start_frame AS source_start, s.end_frame AS source_end, abs((s.start_frame + s.end_frame) / 2 - (d.start_frame + d.end_frame) / 2) AS gap,
  greatest(0, least(d.end_frame, s.end_frame) - greatest(d.start_frame, s.start_frame) + 1) AS o FROM windows d JOIN sparse s ON s.episode_id = d.episode_id),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, window_index ORDER BY gap, o DESC, source_start) AS r FROM m)
SELECT episode_id, window_index, start_frame, end_frame, center_frame, source_index, source_start, source_end,
  CASE WHEN source_start = start_frame THEN 'exact_sparse_window' WHEN o > 0 THEN 'overlap_nearest_sparse_window' ELSE 'gap_nearest_sparse_window' END AS kind,
  gap AS center_distance, o AS overlap_frames, round(o / 20, 6) AS share_of_dense, round(o / 20, 6) AS share_of_source FROM r WHERE r = 1""",
    ),
    "imu_range_join": (
        _imu,
        SQL_BASE + " SELECT episode_id, window_index, CAST(3 * (count(*) - 1) + 1 AS BIGINT) AS samples, round((3 * sum(signal) - 2 * arg_max(signal, frame_idx)) / (3 * count(*) - 2), 6) AS mean FROM members GROUP BY 1, 2",
    ),
    "asof_forward_pose": (
        _asof,
        f"""WITH {SQL_FRAMES}, p AS (SELECT episode_id, frame_idx FROM frames WHERE frame_idx % 10 = 0)
SELECT f.episode_id, f.frame_idx AS at, coalesce((SELECT min(p.frame_idx) FROM p WHERE p.episode_id = f.episode_id AND p.frame_idx >= f.frame_idx), (SELECT max(p.frame_idx) FROM p WHERE p.episode_id = f.episode_id)) AS pose_frame
FROM frames f""",
    ),
}
