"""Phrase collocation mining over weighted acyclic automata.

Tasks count the n-grams of a bounded piece of text, sort them and build a count transducer of
each piece. Transducers are cut by ranges of their prefixes; those of a range are united, their
counts summed, in a tree of bounded fan-in. Parts of phrases are looked up by composing an
acceptor of the parts of a range with its transducer.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windlass.llm.automata import Transducer, built, summed, united
from windlass.llm.common import landed
from windlass.operators.numbering import by_order

MIN_COUNT, MAX_WORDS, TOP, MIN_SHARE = 10, 3, 2000, 50
NO_LANG = "und"
#: Words that a task counts at once, n-grams that a range holds before counts are summed, n-grams
#: for which one is a sample of the order, bytes of a bound's word, transducers united at once.
HELD, RANGE, SAMPLE, BOUND, FAN = 1_500_000, 1_000_000, 4096, 64, 512
#: Parts a language's best rows are first looked for in.
SALTS = 64

_BREAK = b"."
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 9 + b" ")


class _Numbers(dict):
    """Numbers words as they come, from 1; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def tokens(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, with a full stop wherever a piece ends (no word has one)."""
    return [*text.translate(_LOWER).replace(b".", b" . ").split(), _BREAK]


def grams_of(words: list[bytes], ids: np.ndarray, depth: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(labels, n-grams, counts), in order, of word numbers with 0 between pieces; ``words`` are
    the words by number, the first standing for the end of a piece."""
    order = sorted(range(1, len(words)), key=words.__getitem__)
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(1, len(words))
    ids = rank[ids]
    base = len(words)
    found, totals = [], []
    code, rows = ids, np.arange(base)[:, None]  # of a place: the n-gram that ends there, and its words
    for n in range(1, depth + 1):
        if n > 1:
            kept = (code[:-1] > 0) & (ids[n - 1 :] > 0)
            keys, inverse, times = np.unique((code[:-1] * base + ids[n - 1 :])[kept], return_inverse=True, return_counts=True)
            rows = np.concatenate([np.zeros((1, n), np.int64), np.column_stack([rows[keys // base], keys % base])])
            code = np.zeros(len(code) - 1, np.int64)
            code[kept] = inverse + 1
        else:
            times = np.bincount(ids, minlength=base)[1:]
        full = np.zeros((len(rows) - 1, depth), np.int32)
        full[:, :n] = rows[1:]
        found.append(full)
        totals.append(times)
    return [words[k] for k in order], *summed(np.concatenate(found), np.concatenate(totals).astype(np.int64), base)


def _shards(depth: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("lang", pa.string()), ("entries", pa.int64()), ("sample", pa.list_(pa.struct([("first", pa.binary()), ("second", pa.binary())]))), ("held", pa.binary())])
        numbers: dict[str, _Numbers] = {}
        texts: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def made(lang: str):
            ids = np.concatenate(texts.pop(lang))
            sizes.pop(lang)
            labels, grams, counts = grams_of(list(numbers.pop(lang)), ids, depth)
            word = lambda k: labels[k - 1][:BOUND] if k else b""
            sample = [{"first": word(g[0]), "second": word(g[1]) if depth > 1 else b""} for g in grams[SAMPLE // 2 :: SAMPLE].tolist()]
            held = built(labels, grams, counts).dump()
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(grams)]), pa.array([sample], kinds.field("sample").type), pa.array([held], pa.binary())], schema=kinds)

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if lang not in numbers:
                    numbers[lang], texts[lang], sizes[lang] = _Numbers({_BREAK: 0}), [], 0
                found = tokens(value.as_py() or b"")
                texts[lang].append(np.fromiter(map(numbers[lang].__getitem__, found), np.int64, len(found)))
                sizes[lang] += len(found)
                if sizes[lang] >= HELD:
                    yield made(lang)
                elif sum(sizes.values()) >= 2 * HELD:  # many languages: the largest goes first
                    yield made(max(sizes, key=sizes.__getitem__))
        for lang in list(numbers):
            yield made(lang)

    return rows


def shard_transducers(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, entries, sample, held): a count transducer of each piece of the texts of a language
    that a task has counted, how many n-grams it has, and a sample of their first two words."""
    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = "lang string, entries long, sample array<struct<first:binary,second:binary>>, held binary"
    return read.mapInArrow(_shards(max_words), kinds)


def _bounds(shards: DataFrame) -> dict[str, list[tuple[bytes, bytes]]]:
    """The first words of each range but the first, by language. Their number is that of all
    n-grams divided by RANGE, and each has 2 * BOUND bytes at most: the driver holds what any
    sort of the n-grams would."""
    samples = by_order(shards.select("lang", F.explode("sample").alias("s")).select("lang", "s.first", "s.second"), ["lang"], ["first", "second"])
    found: dict[str, list[tuple[bytes, bytes]]] = {}
    for r in samples.where(F.col("_at") % max(1, RANGE // SAMPLE) == 0).select("lang", "first", "second").collect():
        found.setdefault(r["lang"], []).append((bytes(r["first"]), bytes(r["second"])))
    return {k: sorted(set(v)) for k, v in found.items()}


def count_transducers(shards: DataFrame, bounds, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, range, words, held): one transducer of each range of prefixes, with the n-grams that
    have ``min_count`` or more, and the sum of the counts of all its single words.

    ``bounds`` is a broadcast of the ranges' first words. A frequent n-gram stands in every
    piece's transducer; so those of a range are united FAN at a time until one is left.
    """

    def cut_up(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lang, number, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, piece in Transducer.load(held).pieces(bounds.value.get(lang, [])):
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "range": pa.array([k], pa.int64()), "piece": pa.array([number], pa.int64()), "held": pa.array([piece.dump()], pa.binary())})

    def unite(last: bool):
        def body(table):
            import pyarrow as pa

            labels, grams, counts = united([Transducer.load(x) for x in table["held"].to_pylist()])
            words = int(counts[(grams[:, 1:] == 0).all(axis=1)].sum())
            kept = counts >= (min_count if last else 1)
            held = built(labels, grams[kept], counts[kept]).dump()
            return pa.table({"lang": table["lang"][:1], "range": table["range"][:1], "piece": pa.array([table["group"][0].as_py() if "group" in table.column_names else 0], pa.int64()), "words": pa.array([words], pa.int64()), "held": pa.array([held], pa.binary())})

        return body

    kinds = "lang string, range long, piece long, held binary"
    pieces = shards.select("lang", F.xxhash64(F.monotonically_increasing_id()).alias("piece"), "held").mapInArrow(cut_up, kinds)
    left = shards.count()
    while left > FAN:
        left = -(-left // FAN)
        united_kinds = "lang string, range long, piece long, words long, held binary"
        grouped = pieces.withColumn("group", F.pmod("piece", F.lit(left))).groupBy("lang", "range", "group")
        pieces = landed(grouped.applyInArrow(unite(False), united_kinds)).select("lang", "range", "piece", "held")
    return pieces.groupBy("lang", "range").applyInArrow(unite(True), "lang string, range long, piece long, words long, held binary").drop("piece")


def _phrases(batches: Iterator) -> Iterator:
    """(lang, phrase, words, a) of all n-grams of two words and more."""
    import pyarrow as pa

    for batch in batches:
        for lang, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = Transducer.load(held)
            grams, counts = part.entries()
            longer = (grams[:, 1:] > 0).any(axis=1)
            names = [*map(b" ".join, ([part.labels[k - 1] for k in g if k] for g in grams[longer].tolist()))]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(names), pa.string()), "phrase": pa.array(names, pa.binary()).cast(pa.string()), "words": pa.array((grams[longer] > 0).sum(axis=1), pa.int32()), "a": pa.array(counts[longer], pa.int64())})


def part_counts(parts: DataFrame, transducers: DataFrame, bounds, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, part, f): the counts of distinct ``parts`` (lang, part) in ``transducers``. The parts
    of a range make an acceptor, and its composition with the range's transducer gives them."""

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            langs, names = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            two = [(*x.split(b" ", 2)[:2], b"")[:2] for x in names]
            ranges = [bisect_right(bounds.value.get(lang, []), t) for lang, t in zip(langs, two, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranges, pa.int64()), batch.column(1)], names=["lang", "range", "part"])

    def composed(asked, held):
        import pyarrow as pa

        kinds = pa.schema([("lang", pa.string()), ("part", pa.string()), ("f", pa.int64())])
        if not len(asked) or not len(held):
            return kinds.empty_table()
        words = [x.split(b" ") for x in asked["part"].cast(pa.binary()).to_pylist()]
        labels = sorted(set().union(*words))
        number = {w: k + 1 for k, w in enumerate(labels)}
        grams = np.array([[*map(number.__getitem__, w), *[0] * (max_words - len(w))] for w in words], np.int32)
        acceptor = built(labels, *summed(grams, np.ones(len(grams), np.int64), len(labels) + 1))
        found, _, counts = acceptor.compose(Transducer.load(held["held"][0].as_py()))
        names = [b" ".join(labels[k - 1] for k in g if k) for g in found.tolist()]
        return pa.table([pa.array([asked["lang"][0].as_py()] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], schema=kinds)

    asked = parts.select("lang", "part").mapInArrow(placed, "lang string, range long, part string")
    return asked.groupBy("lang", "range").cogroup(transducers.groupBy("lang", "range")).applyInArrow(composed, "lang string, part string, f long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, min_share: int = MIN_SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, of 2 to
    ``max_words`` words with ``min_count`` occurrences or more, by the score of their weakest cut.

    A phrase is dropped if a longer candidate that holds it has ``min_share`` per cent of its
    occurrences. Null texts are empty, a null language is ``und``, repeated rows count as often
    as they stand, texts are read whole; other columns are not read; an empty table gives no
    rows. Scores are exact for counts up to 10^16. Jobs run while this is called: transducers,
    candidates and counts of parts are landed in the checkpoint folder.
    """
    spark = docs.sparkSession
    shards = landed(shard_transducers(docs, lang_col, text_col, max_words))
    bounds = spark.sparkContext.broadcast(_bounds(shards))
    transducers = landed(count_transducers(shards, bounds, min_count))
    phrases = landed(transducers.select("lang", "held").mapInArrow(_phrases, "lang string, phrase string, words int, a long"))
    cuts = (
        phrases.select("lang", "phrase", "words", "a", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    )
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("left").alias("part")), F.struct(F.lit(False).alias("first"), F.col("right").alias("part")))).alias("s")).select("lang", "phrase", "a", "k", "s.first", "s.part")
    counts = landed(part_counts(sides.select("lang", "part").distinct(), transducers, bounds, max_words))
    both = sides.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    # The product of both parts is no smaller than the phrase's square: a score is at most 10^6.
    scored = both.withColumn("score", F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) AS DECIMAL(32,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("s"))
    inner = lambda w, size, n: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice(w, at, size), " "))
    held = [phrases.where(F.col("words") > size).select("lang", "a", F.explode(inner(F.split("phrase", " "), size, F.col("words"))).alias("phrase")) for size in range(2, max_words)]
    kept = best.select("lang", "phrase", "a", "s.*")
    for longer in held:
        most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        kept = kept.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < min_share * F.col("a"))).drop("most")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = kept.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = transducers.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
