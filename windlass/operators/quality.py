"""Checks that return violations: rows (check, key, detail), none if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.functions.text import html_attributes, plain_bounds, sentences
from windlass.operators.joins import leaks

# Patterns of what must not be published.
FORBIDDEN = {
    "local_path": r"/(?:home|Users|root|mnt)/[A-Za-z0-9_.-]+",
    "access_key": r"AKIA[0-9A-Z]{16}",
    "assigned_secret": r"(?i)(?:password|secret|token|api_?key)\s*[:=]\s*\S{6,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def violation(check: str, key: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")]


def union(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(*violation("duplicate_id", F.col(key), F.col("n")))


def split_leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    return leaks(rows, key, split).select(*violation("split_leak", F.col(key), F.col("splits")))


def split_counts(rows: DataFrame, expected: dict[str, int], split: str = "split") -> DataFrame:
    """Splits whose counts differ from those expected, the empty and the unexpected included."""
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).cast("long").alias("want")) for k, v in expected.items()])
    want = rows.sparkSession.range(1).select(F.explode(listed).alias("x")).select("x.*")
    have = rows.groupBy(F.col(split).alias("k")).agg(F.count("*").alias("have"))
    both = want.join(have, "k", "full_outer").na.fill(0, ["want", "have"]).where("want <> have")
    return both.select(*violation("split_count", F.col("k"), F.concat_ws("/", "have", "want")))


def missing_fields(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Rows that lack a required field (null or blank), one violation for each."""
    lacks = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required]), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(lacks).alias("_f")).select(*violation("missing_field", F.col(key), F.col("_f")))


def issue_summary(violations: DataFrame, examples: int = 5) -> DataFrame:
    """Count and first few keys of each check."""
    at = F.row_number().over(Window.partitionBy("check").orderBy("key", "detail"))
    first = violations.withColumn("_a", at)
    return first.groupBy("check").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_a") <= examples, F.col("key")))), "|").alias("examples"))


def manifest_gaps(manifest: DataFrame, order: str = "start") -> DataFrame:
    """Blocks (name, start, end) that do not begin where the one before ended (the first at 0).
    A manifest lists the columns of one matrix and is small by nature."""
    before = F.coalesce(F.lag("end").over(Window.orderBy(order)), F.lit(0))
    return manifest.withColumn("_b", before).where(F.col("start") != F.col("_b")).select(*violation("manifest_gap", F.col("name"), F.concat_ws("/", "_b", "start")))


def stage_gate(rows: DataFrame, passed: list[str], names: list[str]) -> DataFrame:
    """``gate``: the last of the ordered stages up to which all have passed, or "none"."""
    gate, ok = F.lit("none"), F.lit(True)
    for c, n in zip(passed, names, strict=True):
        ok = ok & F.col(c)
        gate = F.when(ok, n).otherwise(gate)
    return rows.withColumn("gate", gate)


def overlap_flag(target: Column, source: Column) -> Column:
    """Whether a target's blocks and its sources' share one."""
    return F.coalesce(F.arrays_overlap(target, source), F.lit(False))


def modality_state(missing: Column) -> Column:
    """complete, preview_missing (only ``.rrd`` files miss) or incomplete."""
    real = F.filter(missing, lambda x: ~x.endswith(".rrd"))
    return F.when(F.size(missing) == 0, "complete").when(F.size(real) == 0, "preview_missing").otherwise("incomplete")


def batch_violations(expected: DataFrame, found: DataFrame, key: str, size: str = "bytes") -> DataFrame:
    have = found.select(F.col(key).alias("_k"), F.col(size).alias("_s"))
    joined = expected.join(have, F.col(key) == F.col("_k"), "left")
    detail = F.when(F.col("_k").isNull(), "missing").when(F.col(size) != F.col("_s"), "size_mismatch")
    return joined.withColumn("_d", detail).where("_d is not null").select(*violation("batch", F.col(key), F.col("_d")))


def forbidden_text(rows: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    found = F.array(*[F.when(F.col(text).rlike(p), n) for n, p in (patterns or FORBIDDEN).items()])
    return rows.select(F.col(key), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_n")).select(*violation("forbidden_text", F.col(key), F.col("_n")))


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page, link, path, fragment) of every href and src."""
    links = pages.select(F.col(key).alias("page"), F.explode(F.concat(html_attributes(F.col(html), "href"), html_attributes(F.col(html), "src"))).alias("link"))
    path = F.url_decode(F.regexp_replace(F.split_part("link", F.lit("#"), F.lit(1)), "%(?![0-9A-Fa-f]{2})", "%25"))
    return links.withColumn("path", path).withColumn("fragment", F.split_part("link", F.lit("#"), F.lit(2)))


def broken_links(links: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """Local links without a target (path), and fragments without an anchor (path, id) in one."""
    local = links.where(~F.col("link").rlike(r"^(?:[a-z][a-z0-9+.-]*:|//)") & (F.col("path") != ""))
    dead = local.join(targets.select("path"), "path", "left_anti")
    live = local.join(targets.select("path"), "path", "left_semi").where("fragment <> ''")
    lost = live.join(anchors.select("path", F.col("id").alias("fragment")), ["path", "fragment"], "left_anti")
    return dead.select(*violation("dead_link", F.col("page"), F.col("link"))).unionByName(lost.select(*violation("dead_anchor", F.col("page"), F.col("link"))))


def repeated_anchors(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    ids = pages.select(F.col(key), F.explode(html_attributes(F.col(html), "id")).alias("_i"))
    return ids.groupBy(key, "_i").agg(F.count("*").alias("n")).where("n > 1").select(*violation("repeated_anchor", F.col(key), F.concat_ws("/", "_i", "n")))


def claims(rows: DataFrame, key: str, text: str, phrases: list[str], negations: str = r"(?i)\b(?:no|not|never|without)\b") -> DataFrame:
    """Sentences that hold one of ``phrases`` and no negation."""
    any_of, none_of = plain_bounds("(?i)" + "|".join(rf"\b{p}\b" for p in phrases)), plain_bounds(negations)
    # Java folds the dotted and the dotless i of Turkish to i; no phrase in other letters means them.
    seen = F.translate("_s", "\u0130\u0131", "\u00a4\u00a4") if not set("\u0130\u0131") & set(any_of + none_of) else F.col("_s")
    said = rows.select(F.col(key), F.explode(sentences(F.col(text))).alias("_s")).where(seen.rlike(any_of) & ~seen.rlike(none_of))
    return said.select(*violation("claim", F.col(key), F.col("_s")))
