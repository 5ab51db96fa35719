"""Selection, split, catalogue and text queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from windlass.functions import geometry as g
from windlass.functions import text as tx
from windlass.operators import features, selection
from windlass.plans.tables import table, vectors

#: An order is an episode, its customer the session, its lines the files.
SQL_FILES = """WITH files AS (
  SELECT o_custkey AS session, l_orderkey AS episode_id, CASE l_linenumber WHEN 1 THEN 'annotation.hdf5' WHEN 2 THEN 'cam0.mp4' WHEN 3 THEN 'cam1.mp4' WHEN 4 THEN 'view.rrd' ELSE 'extra' || l_linenumber END AS name,
         CAST(l_quantity * 1000 AS BIGINT) AS bytes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
eps AS (
  SELECT session, episode_id, count(*) AS file_count, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN name NOT LIKE '%.rrd' THEN bytes ELSE 0 END) AS BIGINT) AS training_bytes,
    CAST(sum(CASE WHEN name LIKE '%.mp4' THEN bytes ELSE 0 END) AS BIGINT) AS video_bytes, CAST(sum(CASE WHEN name LIKE 'annotation%' THEN bytes ELSE 0 END) AS BIGINT) AS annotation_bytes,
    list_sort(list_filter(['annotation.hdf5', 'cam0.mp4', 'cam1.mp4'], lambda x: NOT list_contains(list(name), x))) AS missing
  FROM files GROUP BY 1, 2),
banded AS (
  SELECT *, CASE WHEN total_bytes <= (SELECT quantile_cont(total_bytes, 0.25) FROM eps) THEN 'short' WHEN total_bytes <= (SELECT quantile_cont(total_bytes, 0.5) FROM eps) THEN 'lower_mid'
    WHEN total_bytes <= (SELECT quantile_cont(total_bytes, 0.75) FROM eps) THEN 'upper_mid' ELSE 'long' END AS size_band FROM eps)"""
REQUIRED = ["annotation.hdf5", "cam0.mp4", "cam1.mp4"]


def files(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session"))
    n = F.col("l_linenumber")
    name = F.when(n == 1, "annotation.hdf5").when(n == 2, "cam0.mp4").when(n == 3, "cam1.mp4").when(n == 4, "view.rrd").otherwise(F.concat(F.lit("extra"), n.cast("string")))
    lines = table(s, d, "lineitem").select("l_orderkey", name.alias("name"), (F.col("l_quantity") * 1000).cast("long").alias("bytes"))
    return lines.join(o, "l_orderkey").withColumnRenamed("l_orderkey", "episode_id")


def episodes(s, d):
    return selection.episode_rollup(files(s, d), REQUIRED)


def banded(s, d):
    return selection.size_band(episodes(s, d), "total_bytes")


def _rollup(s, d):
    return episodes(s, d).withColumn("missing", F.array_join("missing", "|")).drop("complete")


def _balanced(s, d):
    rows = banded(s, d).select("episode_id", "session", "size_band", F.abs(F.col("total_bytes") - 90000).cast("double").alias("score"))
    return selection.balanced_pick(rows, 10)


def _families(s, d):
    """Part names stand for labels: their words meet the families of both tables."""
    p = table(s, d, "part").select("p_partkey", F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("pick up", "cut the", "walk to", "N/A", "hold a", "sort", "unknown"))), (F.col("p_partkey") % 7 + 1).cast("int")), "p_name").alias("label"))
    return p.select(
        "p_partkey", tx.family(F.col("label"), tx.ACTION_FAMILIES, "other_fine_action").alias("action_family"), tx.family(F.col("label"), tx.SUBTASK_FAMILIES, "other_fine_subtask").alias("subtask_family"),
        tx.category(F.col("label")).alias("category"),
    )


SQL_LABEL = "WITH l AS (SELECT p_partkey, lower(['pick up', 'cut the', 'walk to', 'N/A', 'hold a', 'sort', 'unknown'][CAST(p_partkey % 7 + 1 AS INTEGER)] || ' ' || p_name) AS t FROM part) "


def _sql_family(families, fallback):
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(t, '{w}')" for w in words)} THEN '{n}'" for n, words in families.items()) + f" ELSE '{fallback}' END"


def _sql_category():
    score = lambda words: " + ".join(f"contains(t, '{w}')::INTEGER" for w in words)
    all_ = ", ".join(f"{{'s': {score(words)}, 'k': {-k}, 'n': '{n}'}}" for k, (n, words) in enumerate(tx.CATEGORIES.items()))
    best = f"list_reverse_sort([{all_}])[1]"
    return f"CASE WHEN {best}.s > 0 THEN {best}.n ELSE 'uncategorized' END"


def _bag(s, d):
    v = tx.hashed_bags(table(s, d, "documents"), "doc_id", "text", 16).withColumnRenamed("vector", "v")
    return v.select("doc_id", *[F.round(F.col("v")[k], 6).alias(f"v{k}") for k in range(16)], F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def _labels(s, d):
    options = F.array(*[F.lit(x) for x in ("red widget", "small", "Large bolt", "blue")])
    raw = F.concat(F.lit("' "), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit(" .\""))
    return table(s, d, "part").select("p_partkey", tx.normalize_label(raw).alias("label"), tx.match_label(raw, options).alias("matched"))


def _messages(s, d):
    c = table(s, d, "conversations")
    asked = F.last(F.when(F.col("role") == "user", F.coalesce("text", F.lit(""))), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    pairs = c.withColumn("q", F.coalesce(asked, F.lit(""))).where("role = 'assistant'")
    made = pairs.select("conv_id", "turn", tx.chat_messages("You describe windows.", F.col("q"), F.coalesce("text", F.lit(""))).alias("m"))
    return made.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["text"].cast("binary")))), "|").alias("messages"))


def _hash(s, d):
    return table(s, d, "documents").select("doc_id", F.round(selection.stable_float("seed", F.col("doc_id")), 9).alias("u"), F.substring(selection.stable_hash("seed", F.col("doc_id")), 1, 12).alias("h"))


def _strings(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", tx.human_bytes(k * k * 1000).alias("size"), tx.duration(k * 37).alias("took"), tx.episode_number(F.concat(F.lit("ep"), k.cast("string"))).alias("number"), tx.natural_key(F.concat(F.lit("a"), k.cast("string"), F.lit("b7"))).alias("sort_key"))


def _rotation(s, d):
    """A vector as eight pairs of quaternions."""
    pairs = vectors(s, d).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pair"), "vector")
    v = pairs.select("id", "pair", g.unit(F.slice("vector", F.col("pair") * 8 + 1, 4)).alias("a"), g.unit(F.slice("vector", F.col("pair") * 8 + 5, 4)).alias("b"))
    r = g.rotation_vector(g.q_multiply(g.q_inverse(F.col("a")), F.col("b")))
    return v.select("id", "pair", *[F.round(r[k], 6).alias(f"r{k}") for k in range(3)])


def _softmax(s, d):
    v = vectors(s, d).select("id", g.softmax(F.col("vector")).alias("p"), F.transform("vector", lambda x: g.sigmoid(x * 500)).alias("q"))
    both = v.select("id", F.posexplode(F.arrays_zip("p", "q")).alias("dim", "z"))
    return both.select("id", "dim", F.round("z.p", 6).alias("p"), F.round("z.q", 6).alias("q"))


def _histogram(s, d):
    return features.value_histogram(table(s, d, "events"), "event_type", "value", 0.0, 200.0)


def _depth(s, d):
    e = table(s, d, "events").select("event_type", F.when(F.col("event_id") % 17 == 0, float("nan")).when(F.col("event_id") % 13 == 0, -1.0).otherwise(F.col("value")).alias("depth"), (F.col("event_id") % 256).cast("double").alias("conf"))
    return features.depth_summary(e, "event_type", "depth", "conf")


def _audio(s, d):
    e = table(s, d, "events").select("user_id", "event_id", (F.col("value") - 20).alias("x"))
    return features.audio_levels(e, "user_id", "event_id", "x")


def _scaled(s, d):
    v = vectors(s, d).select("id", *[F.col("vector")[k].alias(f"x{k}") for k in range(64)], F.lit(3.0).alias("flat"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    made = features.standardize(v, [*[f"x{k}" for k in range(64)], "flat"])
    return made.select("id", F.round("flat", 6).alias("flat"), F.posexplode(F.array(*[f"x{k}" for k in range(64)])).alias("dim", "x")).withColumn("x", F.round("x", 6))


def _image(s, d):
    l = table(s, d, "lineitem").select("l_returnflag", (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y"), F.col("l_quantity").alias("r"), (F.col("l_discount") * 100).alias("g"))  # noqa: E741
    m = features.image_summary(l, "l_returnflag", "x", "y", ["r", "g"], 2)
    return m.select("l_returnflag", "r_mean", "g_mean", "r_std", "g_std", *[F.col("grid")[k].alias(f"g{k}") for k in range(4)])


def _sql_balanced(quota: int = 10):
    """Band after band by name, then the rest, as the bands of sizes are known."""
    bands = sorted(["short", "lower_mid", "upper_mid", "long"])
    fields, order = "episode_id, session, size_band, score", "ORDER BY score, episode_id"
    steps = ["p0 AS (SELECT * FROM best WHERE false)"]
    for k, b in enumerate(bands):
        steps.append(f"p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} UNION ALL SELECT * FROM (SELECT {fields} FROM best WHERE size_band = '{b}' AND session NOT IN (SELECT session FROM p{k}) {order} LIMIT {quota}))")
    last = f"p{len(bands)}"
    return (
        SQL_FILES
        + f""", s AS (SELECT episode_id, session, size_band, abs(total_bytes - 90000)::DOUBLE AS score FROM banded),
best AS MATERIALIZED (SELECT {fields} FROM (SELECT *, row_number() OVER (PARTITION BY session, size_band {order}) AS r FROM s) WHERE r = 1),
{", ".join(steps)},
rest AS (SELECT {fields} FROM (SELECT *, row_number() OVER (PARTITION BY session {order}) AS r FROM best WHERE session NOT IN (SELECT session FROM {last})) WHERE r = 1),
fill AS (SELECT {fields} FROM (SELECT *, row_number() OVER ({order}) AS r FROM rest) WHERE r <= {quota} * (SELECT count(DISTINCT size_band) FROM best) - (SELECT count(*) FROM {last}))
SELECT * FROM {last} UNION ALL SELECT * FROM fill"""
    )


QUERIES = {
    "episode_rollup": (_rollup, SQL_FILES + " SELECT session, episode_id, file_count, total_bytes, training_bytes, video_bytes, annotation_bytes, array_to_string(missing, '|') AS missing FROM eps"),
    "size_distribution": (
        lambda s, d: selection.size_distribution(episodes(s, d), "total_bytes"),
        SQL_FILES
        + " SELECT min(total_bytes) AS min, "
        + ", ".join(f"CAST(round_even(quantile_cont(total_bytes, {p}), 0) AS BIGINT) AS p{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
        + ", max(total_bytes) AS max, CAST(floor(avg(total_bytes)) AS BIGINT) AS mean FROM eps",
    ),
    "index_quantiles": (
        lambda s, d: selection.index_quantiles(episodes(s, d), "total_bytes"),
        SQL_FILES + ", l AS (SELECT list(total_bytes ORDER BY total_bytes) AS l FROM eps) SELECT l[len(l) // 4 + 1] AS q25, l[len(l) // 2 + 1] AS q50, l[3 * len(l) // 4 + 1] AS q75, l[len(l)] AS max FROM l",
    ),
    "percentile_filter": (
        lambda s, d: selection.percentile_filter(episodes(s, d), "training_bytes", 0.05, 5000.0).groupBy("accepted").agg(F.count("*").alias("n")),
        SQL_FILES + " SELECT training_bytes >= greatest((SELECT quantile_cont(training_bytes, 0.05) FROM eps), 5000) AS accepted, count(*) AS n FROM eps GROUP BY 1",
    ),
    "size_bands": (lambda s, d: banded(s, d).groupBy("size_band").agg(F.count("*").alias("n"), F.max("total_bytes").alias("largest")), SQL_FILES + " SELECT size_band, count(*) AS n, max(total_bytes) AS largest FROM banded GROUP BY 1"),
    "best_per_session_band": (
        lambda s, d: selection.best_per(banded(s, d), ["session", "size_band"], "total_bytes", "episode_id").select("session", "size_band", "episode_id"),
        SQL_FILES + " SELECT session, size_band, episode_id FROM (SELECT *, row_number() OVER (PARTITION BY session, size_band ORDER BY total_bytes, episode_id) AS r FROM banded) WHERE r = 1",
    ),
    "balanced_pick": (_balanced, _sql_balanced()),
    "hash_split": (
        lambda s, d: selection.hash_split(banded(s, d), "size_band", "episode_id").select("episode_id", "size_band", "split"),
        SQL_FILES
        + """, h AS (SELECT episode_id, size_band, row_number() OVER (PARTITION BY size_band ORDER BY sha256('split:' || episode_id), episode_id) AS a, count(*) OVER (PARTITION BY size_band) AS n FROM banded)
SELECT episode_id, size_band, CASE WHEN a <= round_even(n * 0.75, 0) THEN 'train' WHEN a <= round_even(n * 0.875, 0) THEN 'val' ELSE 'test' END AS split FROM h""",
    ),
    "guarded_split": (
        lambda s, d: selection.guarded_split(table(s, d, "nation").select("n_name"), "n_name").select("n_name", "split"),
        """WITH h AS (SELECT n_name, row_number() OVER (ORDER BY sha256('split:' || n_name), n_name) AS a, count(*) OVER () AS n FROM nation)
SELECT n_name, CASE WHEN a <= greatest(1, round_even(n * 0.1, 0)) THEN 'test' WHEN a <= 2 * greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM h""",
    ),
    "stratified_split": (
        lambda s, d: selection.stratified_split(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id"),
        """WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('strata:' || doc_id), doc_id) AS a, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN n > 1 AND a <= least(n - 1, greatest(1, round_even(n * 0.25, 0))) THEN 'test' ELSE 'train' END AS split FROM h""",
    ),
    "episode_holdout": (
        lambda s, d: selection.episode_holdout(table(s, d, "documents").select("doc_id", "source"), "source", 0.2).select("doc_id", "split"),
        """WITH k AS (SELECT source, row_number() OVER (ORDER BY source DESC) AS a, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, CASE WHEN a <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM documents JOIN k USING (source)""",
    ),
    "session_round_robin": (
        lambda s, d: selection.round_robin(episodes(s, d), "session", ["episode_id"], 300).select("session", "episode_id", F.col("turn").cast("long").alias("turn")),
        SQL_FILES + " SELECT session, episode_id, row_number() OVER (PARTITION BY session ORDER BY episode_id) AS turn FROM eps ORDER BY turn, session LIMIT 300",
    ),
    "shard_numbers": (
        lambda s, d: selection.shard_numbers(table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 7).select("doc_id", F.col("shard").cast("long").alias("shard")),
        "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 7 AS shard FROM documents",
    ),
    "strided_sample": (
        lambda s, d: selection.strided(table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 9, 2),
        "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS a FROM documents) WHERE a % 9 = 2",
    ),
    "nearest_size": (
        lambda s, d: selection.nearest_size(episodes(s, d), "total_bytes", 100000.0, 25, "episode_id").select("episode_id", "total_bytes"),
        SQL_FILES + " SELECT episode_id, total_bytes FROM eps ORDER BY abs(total_bytes - 100000.0), episode_id LIMIT 25",
    ),
    "pack_batches": (
        lambda s, d: selection.pack_batches(files(s, d).groupBy("session", "episode_id").agg(F.sum("bytes").alias("bytes")), "session", "episode_id", 250_000, 3),
        """WITH RECURSIVE e AS (SELECT o_custkey AS session, l_orderkey AS episode_id, CAST(sum(CAST(l_quantity * 1000 AS BIGINT)) AS BIGINT) AS bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY episode_id) AS r FROM e),
p AS (SELECT session, episode_id, bytes, r, 0::BIGINT AS batch, bytes AS size, 1 AS items FROM n WHERE r = 1
  UNION ALL SELECT n.session, n.episode_id, n.bytes, n.r, CASE WHEN p.size + n.bytes > 250000 OR p.items >= 3 THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.size + n.bytes > 250000 OR p.items >= 3 THEN n.bytes ELSE p.size + n.bytes END,
    CASE WHEN p.size + n.bytes > 250000 OR p.items >= 3 THEN 1 ELSE p.items + 1 END FROM p JOIN n ON n.session = p.session AND n.r = p.r + 1)
SELECT session, episode_id, bytes, batch FROM p""",
    ),
    "label_families": (
        _families,
        SQL_LABEL + f"SELECT p_partkey, {_sql_family(tx.ACTION_FAMILIES, 'other_fine_action')} AS action_family, {_sql_family(tx.SUBTASK_FAMILIES, 'other_fine_subtask')} AS subtask_family, {_sql_category()} AS category FROM l",
    ),
    "label_match": (
        _labels,
        """WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS c FROM part), o AS (SELECT unnest(['red widget', 'small', 'Large bolt', 'blue']) AS o, unnest(range(4)) AS k)
SELECT p_partkey, c AS label, coalesce((SELECT o FROM o WHERE o = c), (SELECT max_by(o, k) FROM o WHERE lower(o) = lower(c)), (SELECT min_by(o, k) FROM o WHERE contains(lower(c), lower(o))), c) AS matched FROM l""",
    ),
    "hashed_bag_of_words": (
        _bag,
        """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents), h AS (SELECT doc_id, CAST('0x' || md5(w)[1:8] AS BIGINT) % 16 AS p, CASE WHEN CAST('0x' || md5(w)[9:10] AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END AS s FROM t),
b AS (SELECT d.doc_id, p, coalesce(sum(s), 0) AS v FROM documents d CROSS JOIN range(16) r(p) LEFT JOIN h USING (doc_id, p) GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM b GROUP BY 1)
SELECT doc_id, """
        + ", ".join(f"round(coalesce(sum(v) FILTER (p = {k}) / nullif(max(n), 0), 0.0), 6)::DOUBLE AS v{k}" for k in range(16))
        + ", round(coalesce(sum(v * v) / nullif(max(n * n), 0), 0.0), 6)::DOUBLE AS norm FROM b JOIN n USING (doc_id) GROUP BY 1",
    ),
    "chat_messages": (
        _messages,
        """WITH p AS (SELECT conv_id, turn, role, coalesce(text, '') AS a, coalesce(last_value(CASE WHEN role = 'user' THEN coalesce(text, '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING), '') AS q FROM conversations)
SELECT conv_id, turn, 'system:' || md5('You describe windows.') || '|user:' || md5(q) || '|assistant:' || md5(a) AS messages FROM p WHERE role = 'assistant'""",
    ),
    "stable_hash": (_hash, "SELECT doc_id, round(CAST('0x' || sha256('seed:' || doc_id)[1:12] AS BIGINT) / power(16, 12), 9) AS u, sha256('seed:' || doc_id)[1:12] AS h FROM documents"),
    "formatted_strings": (
        _strings,
        """WITH p AS (SELECT p_partkey, p_partkey * p_partkey * 1000 AS n, p_partkey * 37 AS t FROM part), u AS (SELECT *, least(5, greatest(0, CAST(floor(log2(greatest(n, 1)) / 10) AS INTEGER))) AS a FROM p)
SELECT p_partkey, format('{:,.2f}', n / power(1024.0, a)) || ' ' || ['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'][a + 1] AS size, format('{:d}:{:02d}:{:02d}', t // 3600, t // 60 % 60, t % 60) AS took, p_partkey AS number,
  'a' || lpad(CAST(p_partkey AS VARCHAR), 18, '0') || 'b' || lpad('7', 18, '0') AS sort_key FROM u""",
    ),
    "relative_rotation": (
        _rotation,
        """WITH w AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, CAST(unnest(range(8)) AS INTEGER) AS pair FROM embeddings), v AS (SELECT id, pair, e[8 * pair + 1:8 * pair + 8] AS e FROM w), u AS (SELECT id, pair, sqrt(list_dot_product(e[1:4], e[1:4])) AS na, sqrt(list_dot_product(e[5:8], e[5:8])) AS nb, e FROM v),
q AS (SELECT id, pair, e[1] / na AS a0, -e[2] / na AS a1, -e[3] / na AS a2, -e[4] / na AS a3, e[5] / nb AS b0, e[6] / nb AS b1, e[7] / nb AS b2, e[8] / nb AS b3 FROM u),
m AS (SELECT id, pair, a0*b0 - a1*b1 - a2*b2 - a3*b3 AS w, a0*b1 + a1*b0 + a2*b3 - a3*b2 AS x, a0*b2 - a1*b3 + a2*b0 + a3*b1 AS y, a0*b3 + a1*b2 - a2*b1 + a3*b0 AS z FROM q),
f AS (SELECT *, sign(w) * 2 * atan2(sqrt(x*x + y*y + z*z), abs(w)) / sqrt(x*x + y*y + z*z) AS f FROM m) SELECT id, pair, round(x * f, 6) AS r0, round(y * f, 6) AS r1, round(z * f, 6) AS r2 FROM f""",
    ),
    "softmax_sigmoid": (
        _softmax,
        """WITH v AS (SELECT vec_id AS id, CAST(unnest(range(64)) AS INTEGER) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT id, dim, round(exp(x) / sum(exp(x)) OVER (PARTITION BY id), 6) AS p, round(1 / (1 + exp(-greatest(-40, least(40, x * 500)))), 6) AS q FROM v""",
    ),
    "value_histogram": (
        _histogram,
        """WITH b AS (SELECT event_type, CAST(greatest(0, least(7, floor(value / 200.0 * 8))) AS INTEGER) AS bin FROM events), c AS (SELECT event_type, bin, count(*) AS c FROM b GROUP BY 1, 2)
SELECT event_type, bin, c, round(c / sum(c) OVER (PARTITION BY event_type), 6) AS share FROM c""",
    ),
    "depth_summary": (
        _depth,
        """WITH e AS (SELECT event_type, CASE WHEN event_id % 17 = 0 OR event_id % 13 = 0 OR value <= 0 THEN NULL ELSE value END AS v, (event_id % 256)::DOUBLE AS c FROM events)
SELECT event_type, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90,
round(count(v) / count(*), 6) AS valid_share, round(avg(c) / 255, 6) AS conf_mean, round(stddev_pop(c) / 255, 6) AS conf_std, round(min(c) / 255, 6) AS conf_min, round(max(c) / 255, 6) AS conf_max FROM e GROUP BY 1""",
    ),
    "audio_levels": (
        _audio,
        """WITH e AS (SELECT user_id, value - 20 AS x, lag(value - 20) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id, round(sqrt(avg(x * x)), 6) AS rms, round(avg(abs(x)), 6) AS mean_abs, round(max(abs(x)), 6) AS peak, round(coalesce(avg(CASE WHEN x * b < 0 THEN 1.0 WHEN b IS NOT NULL THEN 0.0 END), 0.0), 6) AS zcr, round(ln(sum(x * x) + 1e-8), 6) AS log_energy FROM e GROUP BY 1""",
    ),
    "image_summary": (
        _image,
        """WITH p AS (SELECT l_returnflag, l_partkey % 64 AS x, l_orderkey % 64 AS y, l_quantity AS r, l_discount * 100 AS g FROM lineitem)
SELECT l_returnflag, round(avg(r), 6) AS r_mean, round(avg(g), 6) AS g_mean, round(stddev_pop(r), 6) AS r_std, round(stddev_pop(g), 6) AS g_std, round(avg((r + g) / 2) FILTER (x < 32 AND y < 32), 6) AS g0, round(avg((r + g) / 2) FILTER (x >= 32 AND y < 32), 6) AS g1,
  round(avg((r + g) / 2) FILTER (x < 32 AND y >= 32), 6) AS g2, round(avg((r + g) / 2) FILTER (x >= 32 AND y >= 32), 6) AS g3 FROM p GROUP BY 1""",
    ),
    "train_standardize": (
        _scaled,
        """WITH v AS (SELECT vec_id AS id, CAST(unnest(range(64)) AS INTEGER) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings), t AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM v WHERE id % 3 <> 0 GROUP BY 1)
SELECT id, 0.0::DOUBLE AS flat, dim, round((x - m) / s, 6) AS x FROM v JOIN t USING (dim)""",
    ),
}
