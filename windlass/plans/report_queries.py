"""Queries of reports: viewer rows, prediction tables, budgets, versions and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.functions import text as tx
from windlass.operators import reports
from windlass.operators import timeline as t
from windlass.plans.tables import SQL_BASE, SQL_MAJORITY, frames, table
from windlass.sources import files

FPS = 20.0
PHASES = [("smoke", 1), ("smoke_plus", 3), ("pilot", 16), ("next", 32), ("small", 64), ("medium", 128), ("heavy", 256)]
AVAILABLE, PER_EPISODE = 1e7, 9
PRIORITY = {"click": 2, "view": 2, "purchase": 1}


def _viewer(s, d):
    f = frames(s, d)
    sets = t.object_sets(f).select("episode_id", "window_index", F.col("by_first_seen").alias("objects"))
    return reports.viewer_rows(t.majority_label(f, least=0.3), sets, FPS)


def _predictions(s, d):
    windows = t.majority_label(frames(s, d), least=0.3)
    ahead = windows.select("episode_id", (F.col("window_index") - 1).alias("window_index"), F.lit("next").alias("task"), F.col("label").alias("predicted"))
    behind = windows.select("episode_id", (F.col("window_index") + 1).alias("window_index"), F.lit("previous").alias("task"), F.col("label").alias("predicted"))
    return reports.prediction_table(windows.select("episode_id", "window_index", "label"), ahead.unionByName(behind), ["next", "previous"])


def _conditions(s, d):
    made = reports.conditionings({
        "language": F.trim("text") != "", "source": F.col("source").isNotNull(), "long": F.col("n_chars") > 1000, "english": F.col("lang") == "en",
    })
    return table(s, d, "documents").select("doc_id", F.array_join(made, "|").alias("conditions"))


def _state(s, d):
    counts = table(s, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("total"), F.nullif(F.count_if(F.col("o_orderstatus") == "F"), F.lit(0).cast("long")).alias("final"),
        F.nullif(F.count_if(F.col("o_orderstatus") == "P"), F.lit(0).cast("long")).alias("partial"), F.datediff(F.lit("1998-08-01"), F.max("o_orderdate")).alias("age"),
    )
    return reports.evaluation_state(counts, {"final": F.col("final"), "partial": F.col("partial")}, F.col("total"), F.col("age"), 365)


def _last_rows(s, d):
    return files.last_per_key(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


def _present(s, d):
    """Event types between blanks, missing ones as N/A in either case; users of odd numbers by theme."""
    raw = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "N/A").otherwise(" n/a ")).when(F.col("event_id") % 5 == 0, "  ").otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    theme = F.concat(F.lit("theme "), (F.col("event_id") % 3).cast("string"), F.lit(" "))
    return table(s, d, "events").select("event_id", tx.present(F.when(F.col("user_id") % 2 == 1, theme).otherwise(raw)).alias("label"))


QUERIES = {
    "last_row_per_key": (_last_rows, "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1"),
    "present_labels": (
        _present,
        """SELECT event_id, CASE WHEN user_id % 2 = 1 THEN 'theme ' || (event_id % 3) WHEN event_type = 'error' OR event_id % 5 = 0 THEN NULL ELSE event_type END AS label FROM events""",
    ),
    "viewer_rows": (
        _viewer,
        SQL_BASE
        + SQL_MAJORITY
        + """, c AS (SELECT episode_id, window_index, label, min(frame_idx) AS f FROM members WHERE label IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT episode_id, window_index, string_agg(label, '|' ORDER BY f) AS objects, count(*) AS n FROM c GROUP BY 1, 2)
SELECT m.episode_id, m.window_index, start_frame, end_frame, center_frame, label, fraction, round(start_frame / 20, 3) AS start_time_s, round(end_frame / 20, 3) AS end_time_s,
  round(center_frame / 20, 3) AS center_time_s, coalesce(objects, '') AS objects, coalesce(n, 0) AS object_count FROM majority m LEFT JOIN o USING (episode_id, window_index)""",
    ),
    "prediction_table": (
        _predictions,
        SQL_BASE
        + SQL_MAJORITY
        + """ SELECT m.episode_id, m.window_index, m.label, n.label AS next, p.label AS previous FROM majority m
LEFT JOIN majority n ON n.episode_id = m.episode_id AND n.window_index = m.window_index + 1 LEFT JOIN majority p ON p.episode_id = m.episode_id AND p.window_index = m.window_index - 1""",
    ),
    "available_conditionings": (
        _conditions,
        """SELECT doc_id, concat_ws('|', CASE WHEN trim(text) <> '' THEN 'language' END, CASE WHEN source IS NOT NULL THEN 'source' END,
  CASE WHEN n_chars > 1000 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END) AS conditions FROM documents""",
    ),
    "budget_phases": (
        lambda s, d: reports.budget_phases(table(s, d, "orders"), "o_totalprice", AVAILABLE, PHASES, PER_EPISODE),
        f"""WITH m AS (SELECT CAST(floor({AVAILABLE} / avg(o_totalprice)) AS BIGINT) AS most_episodes FROM orders),
p AS (SELECT unnest({[x[0] for x in PHASES]}) AS phase, CAST(unnest({[x[1] for x in PHASES]}) AS BIGINT) AS episodes),
x AS (SELECT *, CAST(CASE WHEN episodes > 1 THEN greatest(1, round_even(episodes * 0.2, 0)) ELSE episodes END AS BIGINT) AS test FROM p, m)
SELECT phase, episodes, most_episodes, episodes <= most_episodes AS feasible, (episodes - test) * {PER_EPISODE} AS train_windows, test * {PER_EPISODE} AS test_windows FROM x""",
    ),
    "current_version": (
        lambda s, d: reports.current_version(table(s, d, "events"), "user_id", "event_type", "value", PRIORITY),
        f"""SELECT user_id, arg_max(event_type, struct_pack(p := CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())} ELSE 0 END, v := coalesce(value, -1.0), r := event_type)) AS current
FROM events GROUP BY 1""",
    ),
    "evaluation_state": (
        _state,
        """WITH c AS (SELECT o_custkey, count(*) AS total, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS final, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS partial,
  CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1998-08-01') AS INTEGER) AS age FROM orders GROUP BY 1)
SELECT *, CASE WHEN final IS NOT NULL THEN 'final' ELSE 'partial' END AS source, coalesce(final, partial) AS completed, greatest(0, total - coalesce(final, partial)) AS remaining,
  CASE WHEN total > 0 THEN round(coalesce(final, partial) / total * 100, 2) END AS percent_complete, CASE WHEN age IS NULL OR age <= 365 THEN 'active' ELSE 'stale' END AS health
FROM c WHERE coalesce(final, partial) IS NOT NULL""",
    ),
}
