"""Queries of counts, splits, blocks, runs and contracts over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.functions import geometry, modalities
from windlass.functions import text as tx
from windlass.operators import features, heads, joins, metrics, quality, retrieval, rollups, selection, slices
from windlass.operators import timeline as t
from windlass.plans.tables import SQL_BASE, SQL_FRAMES, SQL_MAJORITY, frames, table, vectors
from windlass.sources import files
from windlass.streaming import progress

SQL_SPLIT = "CASE WHEN o_custkey % 8 = 0 THEN 'test' WHEN o_custkey % 8 = 1 THEN 'val' WHEN o_custkey % 8 < 7 THEN 'train' END"
#: Beginnings of block names that parts are given, so that part keys stand for feature blocks.
BLOCKS = ["video_rgb", "hand_left_joints", "body_contacts", "camera_translation", "slam_point_cloud", "depth_confidence", "imu_accel_gyro", "audio_mel", "caption_objects_interaction_text", "misc", "calibration"]
NAMES = {"click": "Click", "view": "Page view", "add_to_cart": "Cart"}
SETTINGS = {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "o_orderstatus": ["F", "O"]}
PROPS = "CAST(json_extract_string(props, '$.k') AS VARCHAR)"


def orders(s, d):
    k = F.col("o_custkey") % 8
    return table(s, d, "orders").withColumn("split", F.when(k == 0, "test").when(k == 1, "val").when(k < 7, "train"))


def _blocks(s, d):
    names = F.array(*map(F.lit, BLOCKS))
    block = F.get(names, (F.col("p_partkey") % len(BLOCKS)).cast("int"))
    part = table(s, d, "part").select("p_partkey", block.alias("block"))
    return part.select("p_partkey", "block", modalities.modality(F.col("block")).alias("modality"), *[modalities.in_group(F.col("block"), g).alias(g) for g in ("all_features", *modalities.GROUPS, "no_language")])


def _sql_blocks():
    starts = lambda xs: "(" + " OR ".join(f"starts_with(block, '{x}')" for x in xs) + ")"
    kind = " ".join("WHEN " + " OR ".join(f"starts_with(block, '{x}')" if x.endswith("_") else f"block = '{x}'" for x in xs) + f" THEN '{m}'" for m, xs in modalities.MODALITIES.items())
    groups = ", ".join(f"{starts(xs)} AS {g}" for g, xs in modalities.GROUPS.items())
    return f"""WITH p AS (SELECT p_partkey, {BLOCKS}[CAST(p_partkey % {len(BLOCKS)} AS INTEGER) + 1] AS block FROM part)
SELECT p_partkey, block, CASE {kind} ELSE 'other' END AS modality, true AS all_features, {groups}, NOT {starts(modalities.GROUPS['language'])} AS no_language FROM p"""


def _ranked(s, d):
    v = vectors(s, d)
    q = v.where("id % 20 = 0").select("id", F.slice("vector", 1, 32).alias("vector"), F.col("id").alias("target"))
    found = retrieval.ranks(q, v.select("id", F.slice("vector", 33, 32).alias("vector")))
    by = rollups.retrieval_by_group(found.join(v.select("id", "label"), "id").withColumn("error", 1 - F.col("score")), "label")
    return by.select("label", "queries", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "mean_error")])


def _maps(s, d):
    made = rollups.label_maps(frames(s, d), "episode_id", "label")
    return made.select("episode_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"])), "|").alias("counts"))


def _directories(s, d):
    path = F.col("url")
    listed = table(s, d, "pages").select(F.regexp_extract(path, r"^https?://([^/]+)", 1).alias("host"), F.concat(F.lit("k"), (F.col("page_id") % 7).cast("string")).alias("kind"), F.length("html").alias("bytes"))
    return rollups.directory_stats(listed, "host", "kind", "bytes", ["k0", "k6"])


def _overlay(s, d):
    rows = t.majority_label(frames(s, d), least=0.3).select(
        F.concat(F.lit("task"), (F.col("window_index") % 3).cast("string")).alias("task"), (F.col("label") == "click").cast("int").alias("correct")
    )
    return rollups.task_accuracy(rows.where("correct is not null"), ["task0", "task1", "task2", "task9"])


def _reindexed(s, d):
    return rollups.reindexed(frames(s, d), "label", ["episode_id"], ["frame_idx"]).select("episode_id", "frame_idx", "label", "index")


def _nested(s, d):
    e = table(s, d, "events")
    return e.select(
        "event_id", modalities.nested(F.col("props"), "$.k", 0).alias("k"), modalities.nested(F.col("props"), "$.window.start", -1).alias("window_start"),
        modalities.first_present(F.col("props"), ["$.missing", "$.k", "$.other"]).alias("first"),
    )


def _hot(s, d):
    hot = modalities.hashed_one_hot(F.col("p_brand"), 8, "brand")
    return table(s, d, "part").select("p_partkey", hot.alias("v")).select("p_partkey", *[F.col("v")[k].alias(f"v{k}") for k in range(8)])


def _signed(s, d):
    bag = modalities.signed_bag(F.col("p_name"), 8, "name")
    return table(s, d, "part").select("p_partkey", bag.alias("v")).select("p_partkey", *[F.col("v")[k].alias(f"v{k}") for k in range(8)])


PLACE = "CAST('0x' || md5({})[1:8] AS BIGINT) % {}"


def _losses(s, d):
    flat, wrong = rollups.listed_values(vectors(s, d).select("id", "vector"), "vector", {"run": F.lit("base"), "epoch": F.lit(1)}, 64)
    return flat.select("id", "step", F.round("value", 6).alias("loss"), "run", "epoch").unionByName(wrong.select("id", F.lit(0).alias("step"), F.lit(None).cast("double").alias("loss"), F.lit("wrong").alias("run"), F.lit(0).alias("epoch")))


def _alignment(s, d):
    w = t.majority_label(frames(s, d), least=0.3).select("episode_id", "window_index", "start_frame", "end_frame")
    arrays = w.where("window_index % 11 <> 3").withColumn("end_frame", F.col("end_frame") + (F.col("window_index") % 7 == 2).cast("int"))
    return rollups.alignment_violations(w, arrays, ["episode_id", "window_index"], ["start_frame", "end_frame"])


def _ego(s, d):
    made = t.ego_motion(frames(s, d).select("episode_id", "frame_idx", F.array("signal", F.col("k").cast("double")).alias("vector")))
    return made.select("episode_id", "frame_idx", F.round(F.col("target")[0], 6).alias("t0"), F.round(F.col("target")[1], 6).alias("t1"))


def _enriched(s, d):
    left = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"))
    right = table(s, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.lower("o_orderstatus").alias("status"), F.lower("o_orderpriority").alias("priority"))
    return joins.prefer_left(left, right, "o_orderkey", ["status", "priority"])


def _chunks(s, d):
    spans = table(s, d, "orders").select("o_orderkey", F.explode(geometry.chunk_pairs(F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey") % 37, 8)).alias("p"))
    return spans.select("o_orderkey", "p.left", "p.right", geometry.frame_to_sample(F.col("p.left"), 20.0, 16000.0).alias("sample"))


def _signs(s, d):
    q = vectors(s, d).select(F.col("label").alias("episode_id"), F.col("id").alias("frame_number"), F.slice("vector", 1, 4).alias("quat"))
    made = geometry.continuous_signs(q)
    return made.select("episode_id", "frame_number", *[F.round(F.col("quat")[k], 6).alias(f"q{k}") for k in range(4)])


def _merged(s, d):
    parts = {"region": table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "nation": table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))}
    return files.merge_components(parts)


def log(s, d):
    """Events as the log of runs: a user is a run, an event's place its step."""
    f = frames(s, d)
    kind = F.when(F.col("label").isNull(), "failed").when(F.col("label") == "purchase", "complete").otherwise("step")
    return f.select(
        F.col("episode_id").cast("string").alias("run_id"), kind.alias("event"), (1000.0 + 2 * F.col("frame_idx")).alias("timestamp"), (F.col("frame_idx") + 1).alias("global_step"),
        F.lit(500).cast("long").alias("total_steps"), F.col("signal").alias("loss"),
    )


def _progress(s, d):
    made = progress.run_summary(log(s, d))
    return made.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in made.dtypes])


def _gates(s, d):
    rows = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("a"), (F.col("doc_id") % 3 == 0).alias("b"), (F.col("n_chars") % 2 == 0).alias("c"))
    return quality.stage_gate(rows, ["a", "b", "c"], ["dataset", "training", "evaluation"]).select("doc_id", "gate")


def _manifest(s, d):
    blocks = table(s, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 10).alias("start"), (F.col("n_nationkey") * 10 + 10 - (F.col("n_nationkey") % 6 == 4).cast("int")).alias("end"))
    return quality.manifest_gaps(blocks)


def _overlaps(s, d):
    sets = lambda n, k: F.array(*[(F.col(n) % m).cast("string") for m in k])
    return table(s, d, "documents").select("doc_id", quality.overlap_flag(sets("doc_id", (7, 11)), sets("n_chars", (7, 13))).alias("overlaps"))


def _modality_state(s, d):
    missing = F.array_compact(F.array(F.when(F.col("o_orderkey") % 3 == 0, "preview.rrd"), F.when(F.col("o_custkey") % 5 == 0, "depth.mp4")))
    return table(s, d, "orders").select("o_orderkey", quality.modality_state(missing).alias("state"))


def _batch(s, d):
    want = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("bytes"))
    found = want.where("o_orderkey % 10 <> 3").withColumn("bytes", F.col("bytes") + (F.col("o_orderkey") % 9 == 1).cast("long"))
    return quality.batch_violations(want, found, "o_orderkey")


def _joints(s, d):
    v = vectors(s, d).select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("vector", k * 3 + 1, 3)).alias("joints"))
    made = v.select("id", features.root_centered(F.col("joints")).alias("j"), features.rectangular_finite(F.col("joints")).alias("valid"))
    return made.select("id", "valid", *[F.round(F.col("j")[a][b], 6).alias(f"j{a}{b}") for a in range(4) for b in range(3)])


def _claims(s, d):
    return quality.claims(table(s, d, "documents"), "doc_id", "text", ["the", "licensed"], r"(?i)\b(?:of|and)\b")


def _markers(s, d):
    m = tx.markers(F.col("html"), ["<html", "<title", "<main"], ["<script", "TODO"])
    return table(s, d, "pages").select("page_id", m.alias("m")).select("page_id", F.array_join("m.missing", "|").alias("missing"), F.array_join("m.forbidden", "|").alias("forbidden"))


def _options(s, d):
    opts = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("o"))
    made = opts.select("user_id", tx.bounded_options(F.col("o"), 2, 4).alias("b"), geometry.pad(F.transform("o", lambda x: F.length(x).cast("double")), 8).alias("p"))
    return made.select("user_id", F.array_join("b.shown", "|").alias("shown"), F.col("b.total").alias("total"), F.array_join(F.transform("p", lambda x: x.cast("int").cast("string")), "|").alias("padded"))


def _paths(s, d):
    return table(s, d, "pages").select("page_id", tx.portable_path(F.col("url"), {"https://": "web:", "http://": "plain:", "https://www.": "www:"}).alias("path"))


def _folded(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("a"), F.when(F.col("p_partkey") % 4 == 0, F.upper("p_brand")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" "), F.lower("p_brand"))).when(F.col("p_partkey") % 4 == 2, F.lit("")).otherwise(F.lit("x")).alias("b"))
    return p.select("p_partkey", metrics.folded_match(F.col("a"), F.col("b")).alias("matches"), F.round(metrics.error_score(F.col("p_partkey") % 7), 6).alias("score"))


def _groups(s, d):
    scores = table(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("task"), F.col("l_returnflag").alias("group")).agg(F.round(F.avg("l_quantity"), 6).alias("score"))
    best, other = slices.best_group(scores), slices.best_group(scores, F.col("group") != "N")
    return best.join(other.select("task", F.col("group").alias("other_group"), F.col("score").alias("other_score")), "task", "left")


def _improved(s, d):
    scores = table(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("task"), F.col("l_returnflag").alias("variant")).agg(F.avg("l_discount").alias("score"))
    return slices.improvement(slices.compare_variants(scores, "A", "R", F.lit(True)))


def _split_counts(s, d):
    return quality.split_counts(orders(s, d), {"train": 10, "val": 0, "holdout": 5})


def _fields(s, d):
    docs = table(s, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 17 > 0, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("source")))
    return quality.missing_fields(docs, "doc_id", ["lang", "source", "doc_id"])


def _config(s, d):
    configs = table(s, d, "orders").withColumn("o_custkey", F.when(F.col("o_custkey") % 29 == 0, 0).otherwise(F.col("o_custkey")))
    return rollups.config_violations(configs, "o_orderkey", ["o_orderstatus", "o_orderpriority"], ["o_custkey"], SETTINGS)


def _captions(s, d):
    """Conversations as caption documents: a turn is a segment whose frames are its first words' places."""
    seg = F.struct(
        F.col("role").alias("Sub Task"), F.array(F.struct(F.upper("role").alias("label"))).alias("Current Action"),
        F.create_map(F.lit("1"), F.lit("held")).alias("interaction"),
        F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.least(F.lit(3), F.length(F.coalesce("text", F.lit(""))))), lambda k: (k + F.col("turn") * 10).cast("string")), F.transform(F.sequence(F.lit(0), F.least(F.lit(3), F.length(F.coalesce("text", F.lit(""))))), lambda k: F.array(F.lit("cup"), k.cast("string")))).alias("objects"),
    )
    docs = table(s, d, "conversations").where("conv_id is not null").groupBy(F.col("conv_id").alias("episode_id")).agg(F.collect_list(seg).alias("segments"))
    return files.caption_frames(docs).select("episode_id", "frame_idx", "theme", "action_label", F.array_join("objects", "|").alias("objects"), "interaction")


def _fresh(s, d):
    seen = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("modified"))
    return progress.freshness(seen, F.lit("1997-01-01 00:00:00"), 86400.0 * 365).select("o_orderkey", "age_seconds", "stale")


def _carried(s, d):
    return t.carried_forward(frames(s, d).select("episode_id", "frame_idx", F.col("label").alias("value")), "value")


def _sources(s, d):
    c = table(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("local"), F.count_if(F.col("o_orderstatus") == "O").alias("mirror"), F.count("*").alias("hub"))
    return c.select("o_custkey", files.first_source({"local": F.col("local"), "mirror": F.col("mirror"), "hub": F.col("hub")}, 4).alias("source"))


def _boundaries(s, d):
    """Action boundaries as truth; label runs' ends, some frames off, as predictions."""
    f = frames(s, d)
    truth = t.boundaries(f).select("episode_id", "frame_idx").distinct()
    guess = f.where("k % 5 = 1").select("episode_id", (F.col("frame_idx") + F.col("k") % 3).alias("frame_idx")).distinct()
    return metrics.boundary_matches(truth, guess, 4)


def _prior(s, d):
    docs = table(s, d, "documents").select("doc_id", F.array_distinct(F.array((F.col("doc_id") % 3).cast("string"), (F.col("n_chars") % 11).cast("string"))).alias("true_set"))
    made = heads.prior_predict(docs.where("doc_id % 4 > 0"), docs.where("doc_id % 4 = 0"), most=5, least=0.1)
    return made.select("doc_id", F.array_join("predicted_set", "|").alias("predicted"))


def _edges(s, d):
    """Vectors as images of eight by eight pixels."""
    pixels = vectors(s, d).select("id", F.posexplode("vector").alias("at", "grey"))
    return features.image_edges(pixels.select("id", F.pmod("at", F.lit(8)).alias("x"), F.floor(F.col("at") / 8).alias("y"), "grey"), "id", "x", "y", F.col("grey"))


def _mel(s, d):
    """Vectors as segments of 64 samples."""
    made = features.log_mel_embedding(vectors(s, d).select(F.col("id").alias("key"), F.col("vector").alias("samples")), 8000.0, 32, 8, 6)
    return made.select("key", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.round("value", 6))


SQL_MARKS = lambda xs, neg: "concat_ws('|', " + ", ".join(f"CASE WHEN {'NOT ' * neg}contains(html, '{x}') THEN '{x}' END" for x in xs) + ")"

QUERIES = {
    "distinct_episodes_per_split": (lambda s, d: rollups.distinct_per(orders(s, d), "split", "o_custkey"), f"SELECT {SQL_SPLIT} AS split, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1"),
    "split_scale_counts": (
        lambda s, d: rollups.two_key_counts(orders(s, d).where("split is not null"), "split", "o_orderstatus"),
        f"SELECT split, o_orderstatus, count(*) AS n, grouping(split, o_orderstatus) AS level FROM (SELECT *, {SQL_SPLIT} AS split FROM orders) WHERE split IS NOT NULL GROUP BY CUBE (split, o_orderstatus)",
    ),
    "kind_histogram": (lambda s, d: rollups.histogram(table(s, d, "lineitem"), F.col("l_linenumber")), "SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1"),
    "count_distribution": (
        lambda s, d: rollups.count_distribution(table(s, d, "orders"), "o_custkey"),
        "SELECT rows_per_key, count(*) AS keys FROM (SELECT count(*) AS rows_per_key FROM orders GROUP BY o_custkey) GROUP BY 1",
    ),
    "retrieval_by_label": (
        _ranked,
        """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT id, label, e[1:32] AS a FROM v WHERE id % 20 = 0), c AS (SELECT id, e[33:64] AS b FROM v),
s AS (SELECT q.id, label, c.id AS cid, list_dot_product(a, b) / (greatest(sqrt(list_dot_product(a, a)), 1e-8) * greatest(sqrt(list_dot_product(b, b)), 1e-8)) AS score FROM q CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cid) AS rank FROM s)
SELECT label, count(*) AS queries, round(avg(1 / rank), 6) AS mrr, round(avg(CAST(rank <= 5 AS INTEGER)), 6) AS recall, round(avg(1 - score), 6) AS mean_error FROM r WHERE cid = id GROUP BY 1""",
    ),
    "label_maps": (
        _maps,
        f"WITH {SQL_FRAMES}, c AS (SELECT episode_id, label, count(*) AS n FROM frames WHERE label IS NOT NULL GROUP BY 1, 2) SELECT episode_id, string_agg(label || ':' || n, '|' ORDER BY label) AS counts FROM c GROUP BY 1",
    ),
    "directory_stats": (
        _directories,
        """WITH f AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, 'k' || (page_id % 7) AS kind, length(html) AS bytes FROM pages)
SELECT host, count(*) AS files, sum(bytes)::BIGINT AS bytes, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds,
  concat_ws('|', CASE WHEN NOT bool_or(kind = 'k0') THEN 'k0' END, CASE WHEN NOT bool_or(kind = 'k6') THEN 'k6' END) AS missing FROM f GROUP BY 1""",
    ),
    "task_overlay": (
        _overlay,
        SQL_BASE
        + SQL_MAJORITY
        + """, r AS (SELECT 'task' || (window_index % 3) AS task, CAST(label = 'click' AS INTEGER) AS c FROM majority WHERE label IS NOT NULL)
SELECT n.task, coalesce(sum(c), 0)::BIGINT AS correct, count(c) AS n, round(sum(c) / nullif(count(c), 0), 4) AS share FROM (SELECT unnest(['task0', 'task1', 'task2', 'task9']) AS task) n LEFT JOIN r USING (task) GROUP BY 1""",
    ),
    "split_rows": (
        lambda s, d: rollups.in_splits(orders(s, d), ["test"], unspecified=True).select("o_orderkey", "split"),
        f"SELECT o_orderkey, split FROM (SELECT o_orderkey, {SQL_SPLIT} AS split FROM orders) WHERE split = 'test' OR split IS NULL",
    ),
    "first_of_split": (
        lambda s, d: rollups.in_splits(orders(s, d), ["val"]).orderBy("o_orderkey").limit(25).select("o_orderkey", "split"),
        f"SELECT o_orderkey, split FROM (SELECT o_orderkey, {SQL_SPLIT} AS split FROM orders) WHERE split = 'val' ORDER BY o_orderkey LIMIT 25",
    ),
    "reindexed_labels": (_reindexed, f"WITH {SQL_FRAMES} SELECT episode_id, frame_idx, label, row_number() OVER (PARTITION BY episode_id ORDER BY frame_idx) - 1 AS index FROM frames WHERE label IS NOT NULL"),
    "nested_defaults": (_nested, f"SELECT event_id, coalesce({PROPS}, '0') AS k, coalesce(json_extract_string(props, '$.window.start'), '-1') AS window_start, nullif(trim({PROPS}), '') AS first FROM events"),
    "feature_blocks": (_blocks, _sql_blocks()),
    "hashed_one_hot": (
        _hot,
        f"WITH h AS (SELECT p_partkey, {PLACE.format(chr(39) + 'brand:' + chr(39) + ' || p_brand', 8)} AS p, CASE WHEN {PLACE.format(chr(39) + 'sign:brand:' + chr(39) + ' || p_brand', 2)} = 0 THEN 1.0 ELSE -1.0 END AS s FROM part) SELECT p_partkey, "
        + ", ".join(f"CAST(CASE WHEN p = {k} THEN s ELSE 0.0 END AS DOUBLE) AS v{k}" for k in range(8))
        + " FROM h",
    ),
    "signed_bag": (
        _signed,
        f"""WITH w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part),
h AS (SELECT p_partkey, {PLACE.format(chr(39) + 'name:' + chr(39) + ' || w', 8)} AS p, CASE WHEN {PLACE.format(chr(39) + 'sign:name:' + chr(39) + ' || w', 2)} = 0 THEN 1.0 ELSE -1.0 END AS s FROM w) SELECT p.p_partkey, """
        + ", ".join(f"CAST(coalesce(sum(s) FILTER (p = {k}), 0.0) AS DOUBLE) AS v{k}" for k in range(8))
        + " FROM part p LEFT JOIN h USING (p_partkey) GROUP BY 1",
    ),
    "loss_rows": (
        _losses,
        "SELECT vec_id AS id, CAST(unnest(range(1, 65)) AS INTEGER) AS step, round(unnest(embedding::DOUBLE[]), 6) AS loss, 'base' AS run, 1 AS epoch FROM embeddings WHERE len(embedding) = 64",
    ),
    "display_names": (
        lambda s, d: table(s, d, "events").select("event_id", modalities.display_name(F.col("event_type"), NAMES).alias("shown")),
        "SELECT event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE replace(event_type, '_', ' ') END AS shown FROM events",
    ),
    "config_contract": (
        _config,
        """WITH c AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CASE WHEN o_custkey % 29 = 0 THEN 0 ELSE o_custkey END AS k FROM orders), x AS (
  SELECT o_orderkey, 'missing o_orderstatus' AS w FROM c WHERE coalesce(trim(s), '') = '' UNION ALL SELECT o_orderkey, 'missing o_orderpriority' FROM c WHERE coalesce(trim(p), '') = ''
  UNION ALL SELECT o_orderkey, 'not positive o_custkey' FROM c WHERE NOT coalesce(k > 0, false) UNION ALL SELECT o_orderkey, 'unknown o_orderpriority' FROM c WHERE NOT coalesce(p IN ('1-URGENT', '2-HIGH', '3-MEDIUM'), false)
  UNION ALL SELECT o_orderkey, 'unknown o_orderstatus' FROM c WHERE NOT coalesce(s IN ('F', 'O'), false))
SELECT 'config' AS "check", CAST(o_orderkey AS VARCHAR) AS key, w AS detail FROM x""",
    ),
    "array_alignment": (
        _alignment,
        SQL_BASE
        + SQL_MAJORITY
        + """ SELECT 'alignment' AS "check", episode_id || '/' || window_index AS key, CASE WHEN window_index % 11 = 3 THEN 'only_in_list' ELSE 'differs' END AS detail FROM majority WHERE window_index % 11 = 3 OR window_index % 7 = 2""",
    ),
    "table_contract": (
        lambda s, d: rollups.table_violations(orders(s, d), 7, ["train", "val", "holdout"]),
        """SELECT 'empty_split' AS "check", 'holdout' AS key, '0' AS detail UNION ALL SELECT 'row_count', 'manifest', count(*) || '/7' FROM orders HAVING count(*) <> 7""",
    ),
    "ego_motion": (
        _ego,
        f"""WITH {SQL_FRAMES}, l AS (SELECT episode_id, frame_idx, lead(signal, 4) OVER w - signal AS t0, (lead(k, 4) OVER w - k)::DOUBLE AS t1, lead(frame_idx, 4) OVER w AS n FROM frames WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx))
SELECT episode_id, frame_idx, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM l WHERE n IS NOT NULL""",
    ),
    "capped_round_robin": (
        lambda s, d: selection.round_robin(table(s, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 40).orderBy("doc_id").select("doc_id", "source"),
        "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 40",
    ),
    "enriched_predictions": (
        _enriched,
        """SELECT a.o_orderkey, coalesce(CASE WHEN a.o_orderkey % 3 > 0 THEN a.o_orderstatus END, lower(b.o_orderstatus)) AS status, coalesce(CASE WHEN a.o_orderkey % 5 > 0 THEN a.o_orderpriority END, lower(b.o_orderpriority)) AS priority
FROM orders a LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) b USING (o_orderkey)""",
    ),
    "pending_samples": (
        lambda s, d: joins.pending(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    ),
    "first_root": (
        lambda s, d: joins.first_by_priority(table(s, d, "lineitem"), "l_orderkey", "l_returnflag", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)),
        "SELECT l_orderkey, arg_min(l_returnflag, struct_pack(p := CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, v := l_returnflag)) AS l_returnflag FROM lineitem GROUP BY 1",
    ),
    "chunk_pairs": (
        _chunks,
        """WITH s AS (SELECT o_orderkey, o_custkey AS a, o_custkey + o_orderkey % 37 AS b, unnest(range(8)) AS i FROM orders),
p AS (SELECT o_orderkey, round_even(a + (b - a) * i / 8, 0)::BIGINT AS l, round_even(a + (b - a) * (i + 1) / 8, 0)::BIGINT AS r FROM s)
SELECT o_orderkey, l AS "left", greatest(r, l + 1) AS "right", round_even(l / 20 * 16000, 0)::BIGINT AS sample FROM p""",
    ),
    "continuous_signs": (
        _signs,
        """WITH v AS (SELECT label AS episode_id, vec_id AS frame_number, (embedding::DOUBLE[])[1:4] AS q FROM embeddings), d AS (SELECT *, list_dot_product(q, lag(q) OVER w) AS dot FROM v WINDOW w AS (PARTITION BY episode_id ORDER BY frame_number)),
f AS (SELECT *, CASE WHEN sum(CAST(coalesce(dot < 0, false) AS INTEGER)) OVER (PARTITION BY episode_id ORDER BY frame_number) % 2 = 1 THEN -1.0 ELSE 1.0 END AS s FROM d)
SELECT episode_id, frame_number, """
        + ", ".join(f"round(q[{k + 1}] * s, 6) AS q{k}" for k in range(4))
        + " FROM f",
    ),
    "merged_components": (
        _merged,
        "SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region' AS component, NULL::BIGINT AS parent FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', n_regionkey FROM nation",
    ),
    "run_progress_summary": (
        _progress,
        f"""WITH {SQL_FRAMES}, l AS (SELECT CAST(episode_id AS VARCHAR) AS run_id, CASE WHEN label IS NULL THEN 'failed' WHEN label = 'purchase' THEN 'complete' ELSE 'step' END AS e, 1000.0 + 2 * frame_idx AS ts, frame_idx + 1 AS g, signal AS loss FROM frames),
a AS (SELECT run_id, max(g) AS last_step, 500::BIGINT AS total_steps, min(ts)::DOUBLE AS started, max(ts)::DOUBLE AS latest, round(arg_min(loss, g) FILTER (e = 'step'), 6) AS first_loss, round(arg_max(loss, g) FILTER (e = 'step'), 6) AS final_loss,
  round(min(loss), 6) AS min_loss, round(max(loss), 6) AS max_loss, bool_or(e = 'complete') AS complete, bool_or(e = 'failed') AS failed FROM l GROUP BY 1), r AS (SELECT *, CASE WHEN latest > started THEN last_step / (latest - started) END AS v FROM a)
SELECT * EXCLUDE v, round(v, 6) AS steps_per_second, round(CASE WHEN complete THEN 0.0 ELSE (total_steps - last_step) / v END, 6) AS seconds_left, CASE WHEN failed THEN 'failed' WHEN complete THEN 'complete' ELSE 'running' END AS state FROM r""",
    ),
    "stage_gates": (
        _gates,
        "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND n_chars % 2 = 0 THEN 'evaluation' WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'training' WHEN doc_id % 2 = 0 THEN 'dataset' ELSE 'none' END AS gate FROM documents",
    ),
    "manifest_gaps": (
        _manifest,
        """WITH b AS (SELECT n_name AS name, n_nationkey * 10 AS s, n_nationkey * 10 + 10 - CAST(n_nationkey % 6 = 4 AS INTEGER) AS e FROM nation), l AS (SELECT *, coalesce(lag(e) OVER (ORDER BY s), 0) AS p FROM b)
SELECT 'manifest_gap' AS "check", name AS key, p || '/' || s AS detail FROM l WHERE s <> p""",
    ),
    "source_overlaps": (_overlaps, "SELECT doc_id, list_has_any([CAST(doc_id % 7 AS VARCHAR), CAST(doc_id % 11 AS VARCHAR)], [CAST(n_chars % 7 AS VARCHAR), CAST(n_chars % 13 AS VARCHAR)]) AS overlaps FROM documents"),
    "modality_states": (_modality_state, "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'incomplete' WHEN o_orderkey % 3 = 0 THEN 'preview_missing' ELSE 'complete' END AS state FROM orders"),
    "batch_violations": (
        _batch,
        """SELECT 'batch' AS "check", CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 10 = 3 THEN 'missing' ELSE 'size_mismatch' END AS detail FROM orders WHERE o_orderkey % 10 = 3 OR o_orderkey % 9 = 1""",
    ),
    "root_centered_joints": (
        _joints,
        "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings) SELECT id, true AS valid, " + ", ".join(f"round(e[{3 * a + b + 1}] - e[{b + 1}], 6) AS j{a}{b}" for a in range(4) for b in range(3)) + " FROM v",
    ),
    "text_claims": (
        _claims,
        r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n+', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g') AS t FROM documents), s AS (SELECT doc_id, trim(unnest(string_split(t, chr(1)))) AS x FROM m)
SELECT 'claim' AS "check", CAST(doc_id AS VARCHAR) AS key, x AS detail FROM s WHERE x <> '' AND regexp_matches(x, '(?i)\b(the|licensed)\b') AND NOT regexp_matches(x, '(?i)\b(?:of|and)\b')""",
    ),
    "page_markers": (_markers, f"SELECT page_id, {SQL_MARKS(['<html', '<title', '<main'], True)} AS missing, {SQL_MARKS(['<script', 'TODO'], False)} AS forbidden FROM pages"),
    "option_summaries": (
        _options,
        """WITH o AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS o FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_transform(o[1:2], lambda x: x[1:4]), '|') AS shown, CAST(len(o) AS INTEGER) AS total,
  array_to_string(list_concat(list_transform(o, lambda x: CAST(length(x) AS VARCHAR)), list_transform(range(greatest(0, 8 - len(o))), lambda x: '0')), '|') AS padded FROM o""",
    ),
    "portable_paths": (
        _paths,
        "SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 'www:' || url[13:] WHEN starts_with(url, 'https://') THEN 'web:' || url[9:] WHEN starts_with(url, 'http://') THEN 'plain:' || url[8:] ELSE url END AS path FROM pages",
    ),
    "folded_matches": (_folded, "SELECT p_partkey, p_partkey % 4 < 2 AS matches, round(1 / (1 + p_partkey % 7), 6) AS score FROM part"),
    "best_groups": (
        _groups,
        """WITH s AS (SELECT CAST(l_linenumber AS VARCHAR) AS task, l_returnflag AS g, round(avg(l_quantity), 6) AS score FROM lineitem GROUP BY 1, 2), a AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, g) AS r FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, g) AS r FROM s WHERE g <> 'N') SELECT a.task, a.g AS "group", a.score, b.g AS other_group, b.score AS other_score FROM a LEFT JOIN b ON b.task = a.task AND b.r = 1 WHERE a.r = 1""",
    ),
    "improvement": (
        _improved,
        """WITH s AS (SELECT CAST(l_linenumber AS VARCHAR) AS task, avg(l_discount) FILTER (l_returnflag = 'R') - avg(l_discount) FILTER (l_returnflag = 'A') AS g FROM lineitem GROUP BY 1)
SELECT round(avg(g), 6) AS mean_gain, sum(CAST(g > 0 AS INTEGER))::BIGINT AS improved, count(g) AS tasks FROM s""",
    ),
    "split_count_violations": (
        _split_counts,
        f"""WITH h AS (SELECT {SQL_SPLIT} AS k, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT * FROM (VALUES ('train', 10), ('val', 0), ('holdout', 5)) w(k, want))
SELECT 'split_count' AS "check", coalesce(w.k, h.k) AS key, coalesce(n, 0) || '/' || coalesce(want, 0) AS detail FROM w FULL JOIN h ON h.k = w.k WHERE coalesce(n, 0) <> coalesce(want, 0)""",
    ),
    "missing_fields": (
        _fields,
        """SELECT 'missing_field' AS "check", CAST(doc_id AS VARCHAR) AS key, 'lang' AS detail FROM documents WHERE doc_id % 17 = 0 OR coalesce(trim(lang), '') = ''
UNION ALL SELECT 'missing_field', CAST(doc_id AS VARCHAR), 'source' FROM documents WHERE doc_id % 13 = 0 OR coalesce(trim(source), '') = ''""",
    ),
    "caption_frames": (
        _captions,
        """WITH c AS (SELECT conv_id AS episode_id, turn, role, unnest(range(0, least(3, length(coalesce(text, ''))) + 1)) AS k FROM conversations WHERE conv_id IS NOT NULL)
SELECT episode_id, k + turn * 10 AS frame_idx, role AS theme, upper(role) AS action_label, 'cup|' || k AS objects, CASE WHEN k + turn * 10 = 1 THEN 'held' END AS interaction FROM c""",
    ),
    "file_freshness": (
        _fresh,
        "SELECT o_orderkey, CAST(epoch(TIMESTAMP '1997-01-01') - epoch(CAST(o_orderdate AS TIMESTAMP)) AS DOUBLE) AS age_seconds, epoch(TIMESTAMP '1997-01-01') - epoch(CAST(o_orderdate AS TIMESTAMP)) > 86400.0 * 365 AS stale FROM orders",
    ),
    "carried_labels": (
        _carried,
        f"WITH {SQL_FRAMES} SELECT episode_id, frame_idx, last_value(label IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS value FROM frames",
    ),
    "source_failover": (
        _sources,
        """SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') >= 4 THEN 'local' WHEN count(*) FILTER (o_orderstatus = 'O') >= 4 THEN 'mirror' WHEN count(*) >= 4 THEN 'hub' END AS source FROM orders GROUP BY 1""",
    ),
    "boundary_matches": (
        _boundaries,
        f"""WITH RECURSIVE {SQL_FRAMES}, b AS (SELECT episode_id, frame_idx, label, lag(label) OVER w AS before FROM frames WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)),
tr AS (SELECT episode_id, list(DISTINCT frame_idx) AS ts FROM b WHERE label IS NOT NULL AND before IS NOT NULL AND label <> before GROUP BY 1),
gu AS (SELECT episode_id, list_sort(list(DISTINCT frame_idx + k % 3)) AS gs FROM frames WHERE k % 5 = 1 GROUP BY 1),
a AS (SELECT coalesce(tr.episode_id, gu.episode_id) AS episode_id, coalesce(ts, []) AS ts, coalesce(gs, []) AS gs FROM tr FULL JOIN gu ON gu.episode_id = tr.episode_id),
m AS (SELECT episode_id, ts, gs, 1 AS i, []::BIGINT[] AS used, 0::DOUBLE AS gap FROM a
  UNION ALL SELECT episode_id, ts, gs, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.t) END, gap + coalesce(best.g, 0)
  FROM (SELECT *, list_sort(list_transform(list_filter(ts, lambda x: abs(x - gs[i]) <= 4 AND NOT list_contains(used, x)), lambda x: struct_pack(g := abs(x - gs[i]), t := x)))[1] AS best FROM m WHERE i <= len(gs)))
SELECT episode_id, len(ts) AS "true", len(gs) AS predicted, len(used) AS matched, gap AS gap_sum FROM m WHERE i = len(gs) + 1""",
    ),
    "prior_head": (
        _prior,
        """WITH d AS (SELECT doc_id, unnest(list_distinct([CAST(doc_id % 3 AS VARCHAR), CAST(n_chars % 11 AS VARCHAR)])) AS l FROM documents), c AS (SELECT l, count(*) AS n FROM d WHERE doc_id % 4 > 0 GROUP BY 1 ORDER BY n DESC, l LIMIT 5)
SELECT doc_id, (SELECT string_agg(l, '|' ORDER BY l) FROM c WHERE n >= 0.1 * (SELECT count(*) FROM documents WHERE doc_id % 4 > 0)) AS predicted FROM documents WHERE doc_id % 4 = 0""",
    ),
    "image_edges": (
        _edges,
        """WITH p AS (SELECT vec_id AS id, unnest(range(64)) AS k, unnest(embedding::DOUBLE[]) AS g FROM embeddings), c AS (SELECT id, k % 8 AS x, k // 8 AS y, g FROM p),
d AS (SELECT id, abs(coalesce((lead(g) OVER r - lag(g) OVER r) / 2, lead(g) OVER r - g, g - lag(g) OVER r)) AS dx, abs(coalesce((lead(g) OVER q - lag(g) OVER q) / 2, lead(g) OVER q - g, g - lag(g) OVER q)) AS dy
  FROM c WINDOW r AS (PARTITION BY id, y ORDER BY x), q AS (PARTITION BY id, x ORDER BY y))
SELECT id, round(avg(dx), 6) AS x_mean, round(avg(dy), 6) AS y_mean, round(stddev_pop(dx), 6) AS x_std, round(stddev_pop(dy), 6) AS y_std FROM d GROUP BY 1""",
    ),
    "log_mel_embedding": (_mel, None),
}
