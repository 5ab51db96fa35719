"""Quality rules, line by line first (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.llm.arrays import let
from windlass.llm.common import WORD

GRAM = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A document is rejected if its failed lines hold more than this share of its line characters.
MAX_LOST = 0.5
#: Closing marks that may follow the end of a sentence, and marks that end one.
CLOSERS, TERMINALS = "\"'”’»)] \t\r", (".", "!", "?", "…", ":", ";")
#: Marks that separate the entries of menus and breadcrumbs.
SEPARATORS = r"(?:^|\x20)[|»›·•>](?:\x20|$)"
#: Phrases of short lines that are no content.
BOILERPLATE = (
    r"(?i)all rights reserved|copyright|licen[sc]ed under|released under|terms of (?:use|service)"
    r"|privacy policy|cookie|javascript|sign up|log in|subscribe"
)
BOILERPLATE_CHARS = 300


def line_rules(line: Column) -> dict[str, Column]:
    """The rules that a line can fail, by name."""
    words = F.greatest(F.regexp_count(line, F.lit(WORD)), F.lit(1))
    last = F.right(F.rtrim(line, F.lit(CLOSERS)), F.lit(1))
    return {
        "punctuation": ~last.isin(*TERMINALS) | (F.regexp_count(line, F.lit(r"[!?]{2,}|[#*$%&|<>]{2,}")) * 5 > words),
        "navigation": F.regexp_count(line, F.lit(SEPARATORS)) * 5 > words,
        "boilerplate": (F.length(line) <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE),
    }


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """How many of ``words`` lie in a window of ``gram`` words found twice or more.

    Windows are compared by the 64-bit hash of their words' hashes; sorting brings equal ones
    together, and the marked windows' union is counted in one pass. Most texts have none and
    stop at the count of distinct windows.
    """

    def union(grams: Column) -> Column:
        same = lambda s, j, x: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        starts = let(
            F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
            lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, j - 1, x) | same(s, j + 1, x)), lambda x: x["i"])),
        )
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + gram - F.greatest(a["end"], i)).alias("n"), (i + gram).alias("end")),
            lambda a: a["n"],
        )

    found = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(
            F.transform(F.sequence(F.lit(1), F.size(h) - (gram - 1)), lambda i: F.xxhash64(F.slice(h, i, gram))),
            lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), union(g)).otherwise(0),
        ),
    )
    return F.when(F.size(words) > gram, found).otherwise(0).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Counts, verdict and cleaned text per row of ``docs``.

    A null text is empty: no words, so it fails. Lines without a word neither fail nor count.
    Repeated rows each return; other columns are not read. One narrow projection, no shuffle.
    """
    text = F.col("_text")
    has_word = r"[^\x20\x09-\x0D]"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    bad = lambda line: F.array_max(F.array(*[F.coalesce(x, F.lit(False)).cast("int") for x in line_rules(line).values()]))
    by_word = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    by_line = let(
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(has_word)),
        lambda lines: let(
            F.filter(lines, lambda x: bad(x) == 0),
            lambda good: F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                (F.size(lines) - F.size(good)).cast("long").alias("n_failed_lines"),
                F.length(F.array_join(lines, "")).cast("long").alias("line_chars"),
                F.array_join(good, "\n").alias("cleaned"),
                F.length(F.array_join(good, "")).cast("long").alias("kept_chars"),
            ),
        ),
    )
    counted = rows.select("doc_id", by_word.alias("w"), by_line.alias("l"), F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("w.n_words"))
    return counted.select(
        "doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("l.kept_chars") >= (1 - max_lost) * F.col("l.line_chars"))).alias("kept"),
        "l.n_failed_lines", "l.kept_chars", "l.cleaned",
    )
