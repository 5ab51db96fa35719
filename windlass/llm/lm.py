"""Language-model scoring: word unigrams as the base, causal self-attention as the model."""

from __future__ import annotations

import base64
import itertools
import uuid
from array import array
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import fold, landed

FOLDS, HELD_OUT = 5, 1
#: Words whose counts every worker holds, at most; the counts of all others are joined.
HEAD = 200_000
#: Subword ids of some texts, and bytes of some whose words are numbered, that are worked on together.
GROUP, BYTES = 1 << 17, 6 << 20
#: Windows, at least, that go to a learner in one row.
ROW = 64
#: Windows of one learner (their number grows with the corpus); rounds between averages of their
#: weights; the least steps of a round; windows of a step; the first round's rate.
PER_LEARNER, ROUNDS, LEAST_STEPS, BATCH, RATE = 160_000, 3, 100, 512, 0.03
#: Learners whose weights are averaged in one task, or on the driver at the end.
MERGE = 64
#: Distinct words that a worker remembers, and words it counts before it hands counts on.
REMEMBER, HAND_ON = 400_000, 300_000
#: Characters of a word that are encoded as one piece, as the time grows with their square.
PIECE = 2048


class Words:
    """Numbers words as they come and keeps, for each, its subword ids and its count."""

    def __init__(self, ranks: bytes, known: dict[bytes, int]):
        import numpy as np
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        # A word and the blank before it is a piece. As no word has a blank, an id whose bytes begin with one begins a word.
        self.encode = tiktoken.Encoding("ranks", pat_str=" [^ ]*|[^ ]+", mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.first = np.zeros(1 + max(table.values()), bool)
        self.first[[n for x, n in table.items() if x[:1] == b" "]] = True
        self.known = known
        self.ids, self.begin, self.count, self.word, self.number = array("i"), array("q", [0]), array("q"), [], {}

    def clear(self) -> None:
        """Forgets all words but the known ones, which are met again and again."""
        import numpy as np

        kept = np.flatnonzero(np.frombuffer(self.count, np.int64) >= 0)
        ids, sizes, count = self.subwords(kept), self.sizes(kept), self.counts(kept)
        self.ids, self.begin, self.count = array("i", ids.tobytes()), array("q", np.append(0, np.cumsum(sizes)).tobytes()), array("q", count.tobytes())
        self.word = [self.word[k] for k in kept.tolist()]
        self.number = {w: k for k, w in enumerate(self.word)}

    def numbers(self, words: list[bytes]):
        import numpy as np

        new = set(words).difference(self.number)
        if new:
            self._learn([w for w in new if len(w) < PIECE], [w for w in new if len(w) >= PIECE])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _learn(self, short: list[bytes], long: list[bytes]) -> None:
        """Numbers new words: all short ones are encoded by one call, long ones in pieces."""
        import numpy as np

        ids = np.array(self.encode("".join([" " + w.decode(errors="replace") for w in short])), np.int32)
        at = np.append(np.flatnonzero(self.first[ids]), len(ids))[1:]
        self.begin.frombytes((at + len(self.ids)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.tobytes())
        for word in long:
            piece = " " + word.decode(errors="replace")
            for lo in range(0, len(piece), PIECE):
                self.ids.extend(self.encode(piece[lo : lo + PIECE]))
            self.begin.append(len(self.ids))
        new, n = short + long, len(self.word)
        self.count.extend(map(self.known.get, new, itertools.repeat(-1)))
        self.word += new
        self.number.update(zip(new, range(n, n + len(new)), strict=True))

    def subwords(self, numbers):
        """The ids of numbered words in a row."""
        import numpy as np

        begin, ids = np.frombuffer(self.begin, np.int64), np.frombuffer(self.ids, np.int32)
        low, size = begin[numbers], begin[numbers + 1] - begin[numbers]
        ends = np.cumsum(size)
        return ids[np.repeat(low - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def sizes(self, numbers):
        import numpy as np

        return np.diff(np.frombuffer(self.begin, np.int64))[numbers]

    def counts(self, numbers):
        import numpy as np

        return np.frombuffer(self.count, np.int64)[numbers]


_KEPT: dict = {}


def _words(shared) -> Words:
    """The worker's table for a broadcast value (ranks, head counts), kept between tasks."""
    if _KEPT.get("of") != shared.value[2]:
        _KEPT.clear()
        _KEPT.update(of=shared.value[2], table=Words(shared.value[0], shared.value[1]))
    table = _KEPT["table"]
    if len(table.word) > REMEMBER:
        table.clear()
    return table


def _portions(texts) -> Iterator[tuple[int, int]]:
    """Ranges of the texts of an Arrow column, of ``BYTES`` or one text each."""
    import numpy as np
    import pyarrow.compute as pc

    ends, lo = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES, "right")))
        yield lo, hi
        lo = hi


def _split(texts):
    """The words of the texts of an Arrow column in a row, A-Z lower-cased, as numbers; the distinct words
    that these stand for; and where each text begins and the last ends. Arrow's ASCII white space is that of
    ``bytes.split``, but it leaves empty words at a text's edges."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.binary()).view(pa.string())  # not checked again: any bytes may be in it
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded, edges = found.values.view(pa.binary()).dictionary_encode(), np.asarray(found.offsets)
    at, words = np.asarray(coded.indices), coded.dictionary
    for blank in np.flatnonzero(np.asarray(pc.binary_length(words)) == 0).tolist():
        kept = at != blank
        edges = np.concatenate([[0], np.cumsum(kept)])[edges]
        at, words = at[kept], pa.concat_arrays([words[:blank], words[blank + 1 :]])
        at = at - (at > blank)
    return at, words, edges


def _counter(batches: Iterator) -> Iterator:
    """(word, n) of the training texts, and their ends under the word that no text can hold."""
    import numpy as np
    import pyarrow as pa

    held, rows, ends = [], 0, 0

    def summed():
        made = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return made.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks()

    for batch in batches:
        ends += len(batch)
        for lo, hi in _portions(batch.column(0)):
            at, words, _ = _split(batch.column(0)[lo:hi])
            held.append(pa.table({"word": words, "n": np.bincount(at, minlength=len(words)).astype(np.int64)}))
            rows += len(words)
            if rows > 2 * HAND_ON:
                held = [summed()]
                rows = len(held[0])
                if rows > HAND_ON:
                    yield from held.pop().to_batches()
                    rows = 0
    if ends:
        held.append(pa.table({"word": pa.array([b" "], pa.binary()), "n": pa.array([ends], pa.int64())}))
        yield from summed().to_batches()


def _encoder(shared):
    def encode(batches: Iterator) -> Iterator:
        """(id, n): counts of subword ids from counts of words."""
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            table = _words(shared)
            numbers, n = table.numbers(batch.column(0).to_pylist()), np.asarray(batch.column(1))
            ids, per = table.subwords(numbers), table.sizes(numbers)
            found = np.bincount(ids, np.repeat(n, per)).astype(np.int64)
            if len(found) > len(total):
                total = np.pad(total, (0, len(found) - len(total)))
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    return encode


def _encoded(shared, end: int, totals: tuple[int, int]):
    """Per text: its subword ids, its sizes and base score as far as the head's counts go, and the
    words whose counts have to be joined."""

    def run(batches: Iterator) -> Iterator:
        import math

        import numpy as np
        import pyarrow as pa

        bottom, most = math.log10(totals[0] + 0.5 * (totals[1] + 1)), shared.value[1]
        names = ["row", "doc_id", "held_out", "ids", "n_tokens", "n_known", "base", "rest"]
        for batch in batches:
            for lo, hi in _portions(batch.column(3)):
                part, table = batch.slice(lo, hi - lo), _words(shared)
                at, words, edges = _split(part.column(3))
                numbers, n = table.numbers(words.to_pylist()), hi - lo
                count, ids = table.counts(numbers), table.subwords(numbers[at]).astype(id_type(end))
                spots = np.concatenate([[0], np.cumsum(table.sizes(numbers)[at])])[edges] * ids.itemsize
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(spots.astype(np.int32)), pa.py_buffer(ids)])
                owner, head = np.repeat(np.arange(n), np.diff(edges)), (count >= 0)[at]
                n_tokens = np.diff(edges) + 1
                n_known = np.bincount(owner[head], minlength=n) + (b" " in most)
                base = np.bincount(owner, np.log10(np.where(count >= 0, count, 0.5) + 0.5)[at], n) + math.log10(most.get(b" ", 0) + 0.5) - bottom * n_tokens
                key, times = np.unique(owner[~head] * len(words) + at[~head], return_counts=True)
                of, word = np.divmod(key, max(1, len(words)))
                rest = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(times.astype(np.int64))], names=["word", "n"])
                per = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
                held = pa.array(np.asarray(part.column(2)) == HELD_OUT)
                made = [pa.array(c.astype(t)) for c, t in ((n_tokens, np.int64), (n_known, np.int64), (base, np.float64))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), held, ids, *made, pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), rest)], names=names)

    return run


def id_type(end: int):
    """The smallest type that holds all subword ids and the end."""
    import numpy as np

    return np.uint16 if end < 1 << 16 else np.int32


def _windower(kinds, end: int, size: int, turn: int):
    def windows(batches: Iterator) -> Iterator:
        """This round's training windows of ``size`` classes: each id and the end of a text is the
        target of exactly one window, and each window belongs to exactly one round."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, texts = np.asarray(batch.column(0)), [np.frombuffer(x.as_py(), id_type(end)) for x in batch.column(1)]
            ends, lo = np.cumsum([len(x) + 1 for x in texts]), 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GROUP, "right")))
                made = _cut(rows[lo:hi], texts[lo:hi], kinds, end, size, turn)
                edges = np.arange(0, made.nbytes + 1, 2 * size, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(edges), pa.py_buffer(made)])], names=["window"])
                lo = hi

    return windows


def _cut(rows, texts: list, kinds, end: int, size: int, turn: int):
    """The windows of one round, of texts by their rows and ids."""
    import numpy as np

    n = np.array([len(x) for x in texts])
    # Windows share one id: the last target of one is the first input of the next.
    whole = n // (size - 1) + 1
    span = whole * (size - 1) + 1
    at = np.cumsum(span) - span
    flat = np.full(span.sum(), -1, np.int16)
    for x, a in zip(texts, (at + 1).tolist(), strict=True):
        flat[a : a + len(x)] = kinds[x]
    flat[at] = flat[at + n + 1] = kinds[end]
    nth = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    mine = (np.repeat(rows, whole) + nth) % ROUNDS == turn
    return np.lib.stride_tricks.sliding_window_view(flat, size)[(np.repeat(at, whole) + nth * (size - 1))[mine]]


def _dealt(windows):
    def deal(batches: Iterator) -> Iterator:
        """The windows in rows of some, each from all over its batch, as a row each costs more than its windows."""
        import pyarrow as pa

        for batch in windows(batches):
            found = _windows(batch.column(0))
            n = max(1, len(found) // ROW)
            yield pa.RecordBatch.from_arrays([pa.array([found[k::n].tobytes() for k in range(n)], pa.binary())], names=["window"])

    return deal


def _windows(column):
    """The windows of an Arrow column, (n, classes), without an object for each."""
    import numpy as np

    from windlass.llm.attention import CONTEXT

    if not len(column):
        return np.zeros((0, CONTEXT + 1), np.int16)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int16)[edges[0] // 2 : edges[-1] // 2].reshape(-1, CONTEXT + 1)


def _learner(model: bytes, turn: int):
    def learn(batches: Iterator) -> Iterator:
        """One learner's weights after a pass over this round's windows."""
        import numpy as np
        import pyarrow as pa

        from windlass.llm import attention

        held = [x for x in (_windows(batch.column(0)) for batch in batches) if len(x)]
        if held:
            windows = np.concatenate(held)
            steps = max(LEAST_STEPS, -(-len(windows) // BATCH))
            made = attention.train(attention.unpack(model), windows, np.arange(attention.CLASSES), steps, RATE / (1 + turn), turn, BATCH)
            yield pa.RecordBatch.from_arrays([pa.array([attention.pack(made)], pa.binary()), pa.array([1], pa.int64())], names=["model", "n"])

    return learn


def _mean(models: list[tuple[bytes, int]]) -> tuple[bytes, int]:
    import numpy as np

    total, n = 0.0, 0
    for model, k in models:
        total, n = total + np.frombuffer(model, np.float32).astype(np.float64) * k, n + k
    return (total / n).astype(np.float32).tobytes(), n


def _merge(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held = [x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    if held:
        model, n = _mean(held)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary()), pa.array([n], pa.int64())], names=["model", "n"])


def _averaged(models: DataFrame, n: int) -> bytes | None:
    """The mean of ``n`` learners' weights, by stages of ``MERGE``; None without any."""
    while n > MERGE:
        n = -(-n // MERGE)
        models = models.repartition(n).mapInArrow(_merge, "model binary, n long")
    held = [(bytes(x[0]), x[1]) for x in models.collect()]
    return _mean(held)[0] if held else None


def _scorer(maps, model: bytes, end: int):
    def run(batches: Iterator) -> Iterator:
        """The rows with their model score for their ids."""
        import math

        import numpy as np
        import pyarrow as pa

        from windlass.llm import attention

        net = attention.unpack(model)
        for batch in batches:
            group, of, size, found = {}, [], 0, []  # copies that stand together are scored once
            for k, value in enumerate(batch.column(0)):
                ids = value.as_py()
                if ids not in group:
                    size += len(ids) // id_type(end)(0).nbytes + 1
                of.append(group.setdefault(ids, len(group)))
                if size >= GROUP or k == len(batch) - 1:
                    found.append(attention.score(net, [np.frombuffer(x, id_type(end)) for x in group], *maps, end)[of] / math.log(10))
                    group, of, size = {}, [], 0
            score = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], score], names=[*batch.schema.names[1:], "score"])

    return run


def score_documents(docs: DataFrame, ranks: str, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score; null and empty texts are an end alone, and extra columns are not read.

    A text is its words, A-Z lower-cased, and an end. The base is an add-half unigram over the
    words of all documents outside the held-out fold (a null id counts as the empty text). The
    model reads the words' subword ids, by the public byte-pair vocabulary in the file ``ranks``
    (lines of base64 bytes and a rank; read on the driver): it predicts a class by causal
    self-attention, which for frequent ids is the id itself, and rare ids by their frequency in the class. Classes and
    frequencies come from all training words. Attention learns from every id of every training
    text: as many tasks as the windows need each take their part of a round's windows, and their
    weights are averaged after the round.

    The counts of up to ``head`` of the most frequent words go to every worker. Other words
    are counted within each text and joined with the counts by word.
    """
    import numpy as np

    from windlass.llm import attention

    spark, data = docs.sparkSession, Path(ranks).read_bytes()
    end = 1 + max(int(x.split()[1]) for x in data.splitlines())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = fold(F.col("doc_id"), FOLDS)
    counts = landed(texts.where(part != HELD_OUT).select("text").mapInArrow(_counter, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The head is cut at a step of the counts, not by a sorted limit that every task would send whole.
    step = F.floor(F.log2("n") * 8).cast("int")
    kept, least = 0, 1 << 30
    for k, n in sorted(counts.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if kept + n > head:
            break
        kept, least = kept + n, k
    most = {bytes(w): n for w, n in counts.where((step >= least) | (F.col("word") == b" ")).collect()}
    shared = spark.sparkContext.broadcast((data, most, uuid.uuid4().hex))

    ids = np.zeros(end + 1)
    words = counts.where(F.col("word") != b" ")
    for k, n in words.mapInArrow(_encoder(shared), "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        ids[k] = n
    ids[end] = most.get(b" ", 0)
    maps = attention.vocabulary(ids)
    model = attention.pack(attention.start(np.bincount(maps[0], ids, attention.CLASSES)))

    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", part.cast("int").alias("fold"), "text")
    schema = "row long, doc_id long, held_out boolean, ids binary, n_tokens long, n_known long, base double, rest array<struct<word:binary,n:long>>"
    encoded = landed(rows.mapInArrow(_encoded(shared, end, (total, kinds)), schema))
    # A text of n ids and its end makes n // CONTEXT + 1 windows, so this many at most.
    learners = max(1, int(ids[:end].sum() // attention.CONTEXT + ids[end]) // PER_LEARNER)
    training = encoded.where("not held_out").select("row", "ids")
    for turn in range(ROUNDS):
        made = training.mapInArrow(_dealt(_windower(maps[0].astype(np.int16), end, attention.CONTEXT + 1, turn)), "window binary").repartition(learners)
        model = _averaged(landed(made.mapInArrow(_learner(model, turn), "model binary, n long")), learners) or model

    narrow = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double"
    scored = encoded.select("ids", "row", "doc_id", "held_out", "n_tokens", "n_known", "base").mapInArrow(_scorer(maps, model, end), f"{narrow}, score double")
    rest = encoded.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(counts.select("word", F.col("n").alias("c")), "word", "left")
    added = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("more"),
    )
    return scored.join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
