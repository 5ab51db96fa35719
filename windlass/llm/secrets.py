"""Secret scans by pattern and by sliding-window entropy (native: DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.llm.arrays import let, running_sums

#: Base kinds in their listed order: name, pattern, the group that is measured, its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Patterns that skip most matches which ``BASE`` drops for their length. A run of these
#: characters is matched whole from its start, so leaving short ones out changes no other match.
LONG_ONLY = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
#: Kinds that entropy adds, by character class: name, what a candidate must and must not hold,
#: and the least entropy in bits that one of its windows must reach.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", (r"[0-9]", r"[A-Fa-f]"), 3.1),
    ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", (r"[0-9]", r"[A-Z]", r"[a-z]"), 3.7),
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Candidates that match one of these are no secrets: UUIDs, examples, repeated characters, dates.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i:example|sample|dummy|placeholder|changeme)",
    r"(.)\1{7}",
    r"(19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]",
)
_SCALE = 1_000_000
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, pattern: str, group: int, kind: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters."""
    found = let(
        F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
            (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")).alias("g"),
            F.split(text, pattern, -1).alias("between"),
        ),
        lambda x: let(
            running_sums(F.zip_with(x["m"], F.slice(x["between"], 1, F.size(x["m"])), lambda m, b: F.length(m) + F.length(b))),
            lambda ends: F.filter(
                F.transform(
                    x["m"],
                    lambda m, i: F.struct(
                        (F.get(ends, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), F.length(F.get(x["g"], i) if group else m).alias("n")
                    ),
                ),
                lambda s: s["n"] >= least,
            ),
        ),
    )
    spans = F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array()).cast(_SPAN)


def peak_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` characters in a row of ``text``.

    One pass that carries the window's counts by character: the one that enters adds one to its
    count, the one that leaves takes one off, and the sum of c * log2(c) changes only by these
    two. The terms are whole millionths, so nothing drifts. Null for a shorter text.
    """
    terms = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0).cast("long") for c in range(window + 2)])
    term = lambda n: F.get(terms, n)

    def step(codes: Column, acc: Column, p: Column) -> Column:
        full, x, y = p >= window, F.get(codes, p), F.get(codes, p - window)
        n, m = F.get(acc["counts"], y), F.get(acc["counts"], x) - F.when(full & (x == y), 1).otherwise(0)
        total = acc["sum"] - F.when(full, term(n) - term(n - 1)).otherwise(0) + term(m + 1) - term(m)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == x, 1).otherwise(0) - F.when(full & (k == y), 1).otherwise(0))
        return let(total, lambda s: F.struct(s.alias("sum"), F.when(p >= window - 1, F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"), counts.alias("counts")))

    def lowest(codes: Column, alphabet: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("low"), F.array_repeat(F.lit(0), F.size(alphabet)).alias("counts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, lambda acc, p: step(codes, acc, p), lambda acc: acc["low"])

    low = let(
        F.split(text, ""),
        lambda chars: let(
            F.array_distinct(chars),
            lambda alphabet: let(F.transform(chars, lambda c: (F.array_position(alphabet, c) - 1).cast("int")), lambda codes: lowest(codes, alphabet)),
        ),
    )
    return F.when(F.length(text) >= window, math.log2(window) - low / (_SCALE * window))


def _entropic(text: Column, base: Column, allow: Sequence[str]) -> Column:
    """Spans of candidates of high entropy that no base span overlaps and the allow-list leaves."""
    wanted = lambda c: F.lit(False) if not CLASSES else _any(*[_all(c.rlike(whole), *[c.rlike(m) for m in must]) for _, whole, must, _ in CLASSES])
    kind = lambda c: F.coalesce(*[
        F.when(_all(c.rlike(whole), *[c.rlike(m) for m in must]), F.when(peak_entropy(c) >= bits, F.lit(len(BASE) + k)).otherwise(-1)) for k, (_, whole, must, bits) in enumerate(CLASSES)
    ], F.lit(-1))
    spans = let(
        _matches(text, CANDIDATE, 0, 0, WINDOW),
        lambda all_: F.filter(
            F.transform(
                F.filter(
                    F.transform(all_, lambda s: F.struct(s["start"], s["end"], F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("c"))),
                    lambda s: wanted(s["c"]) & ~_any(F.lit(False), *[s["c"].rlike(a) for a in allow]),
                ),
                lambda s: F.struct(s["start"], kind(s["c"]).alias("kind"), s["end"]),
            ),
            lambda s: (s["kind"] >= 0) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        ),
    )
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array()).cast(_SPAN)


def _all(first: Column, *rest: Column) -> Column:
    for x in rest:
        first = first & x
    return first


def _any(first: Column, *rest: Column) -> Column:
    for x in rest:
        first = first | x
    return first


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = ALLOW) -> DataFrame:
    """(doc_id, base, added): arrays of (start, kind, end) per row of ``docs``, in code points.

    ``base`` holds what the three patterns find, by start and then kind; ``added`` holds high
    entropy candidates besides. A null text is empty; empty texts have no spans; repeated rows
    each return; other columns are not read. All of it is one narrow projection: no shuffle.
    """
    text = F.col("_text")
    base = F.array_sort(F.concat(*[_matches(text, LONG_ONLY.get(name, p), g, k, n) for k, (name, p, g, n) in enumerate(BASE)]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = rows.select("doc_id", let(base, lambda b: F.struct(b.alias("base"), F.array_sort(_entropic(text, b, allow)).alias("added"))).alias("_f"))
    return found.select("doc_id", "_f.base", "_f.added")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x[0]) for x in (*BASE, *CLASSES)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns, from what ``find_secrets`` returns."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
