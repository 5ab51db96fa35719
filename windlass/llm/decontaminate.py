"""Benchmark decontamination by latent semantic retrieval and exact checks."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import cut, landed

#: Hashed terms (two bytes each in the token table), latent dimensions, and those sketched.
TERMS, DIMS, SKETCH = 1 << 14, 48, 56
#: Words of a TF-IDF passage; words of a text that a worker searches at once.
PASSAGE, BLOCK = 128, 1 << 14
#: Words of some texts whose passages are counted together; few enough to stay in a cache.
SKETCH_WORDS, SKETCH_ROWS = 1 << 14, 32
#: Least cosine of a window to an item for a candidate.
MIN_COSINE = 0.15
#: A document leaks an item if their common subsequence covers this share of the item's words,
#: or the lower share with the item's answer (its last words) standing whole in the same place.
COVER, COVER_WITH_ANSWER, ANSWER = 0.75, 0.5, 4
#: The benchmark is the stated query set; every worker holds a slice of it, of so many items and
#: characters at most (or one item), and larger ones are searched slice by slice.
SLICE_ITEMS, SLICE_CHARS = 20_000, 20_000_000
#: Least words of a tile; regions and items that are compared at once.
TILE, PAIRS = 32, 2048
#: Window lengths grow by this factor from the least one, by STEP words at least; windows begin
#: and end at multiples of STEP words, which a power of two makes.
GROWTH, LEAST, STEP = 1.15, 8, 4
#: Windows of an item, in lengths of it (a paraphrase may have words put in), and windows that
#: begin within the length of one.
LENGTHS, PER_WINDOW = (1.0, 1.3), 4
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and anything that is not ASCII."""
    return (text or b"").translate(_TABLE).split()


def term_ids(words: list[bytes]):
    import numpy as np

    return (np.fromiter(map(crc32, words), np.uint32, len(words)) % TERMS).astype(np.uint16)


def places(a: list) -> dict:
    """The positions of each element of ``a``, as an integer's bits."""
    where: dict = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    return where


def lcs_length(a: list, b: list, where: dict | None = None) -> int:
    """Length of the longest common subsequence, all rows of the table in one integer's bits;
    ``where`` is ``places(a)``."""
    where = places(a) if where is None else where
    full = (1 << len(a)) - 1
    row = full
    for bits in filter(None, map(where.get, b)):
        met = row & bits
        if met:
            row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def window_length(n: float) -> int:
    """The window length for ``n`` words: the largest of the series not above it (the least one
    for items that are shorter still)."""
    w = LEAST
    while (longer := max(w + STEP, int(w * GROWTH) // STEP * STEP)) <= n:
        w = longer
    return w


def _token_table(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        ids = [term_ids(tokens(x.as_py())).tobytes() for x in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "th", "ids"])


def _passages(batches: Iterator) -> Iterator:
    """Of some texts at a time: (passage, term, count) of each distinct term of each passage."""
    import numpy as np

    for batch in batches:
        held, size = [], 0
        values = batch.column(batch.schema.get_field_index("ids"))
        for k, value in enumerate(values):
            held.append(np.frombuffer(value.as_py(), np.uint16))
            size += len(held[-1])
            if size and (size > SKETCH_WORDS or k == len(values) - 1):
                lengths = np.array([len(x) for x in held])
                per = -(-lengths // PASSAGE)
                first = np.repeat(np.cumsum(per) - per, lengths) + (np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // PASSAGE
                ids, first = np.concatenate(held), first.astype(np.uint32)
                for at in range(0, size, 1 << 16):  # a very long text is more than one block; its passages start anew
                    passage = first[at : at + (1 << 16)]
                    key = np.sort((passage - passage[0]) * np.uint32(TERMS) + ids[at : at + (1 << 16)])
                    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    yield (key[new] // TERMS).astype(np.int64), (key[new] % TERMS).astype(np.int64), np.diff(np.append(new, len(key))).astype(np.float32)
                held, size = [], 0


def _document_counts(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    df, total = np.zeros(TERMS + 1, np.int64), np.zeros(TERMS + 1, np.int64)
    for passage, term, count in _passages(batches):
        df[:TERMS] += np.bincount(term, minlength=TERMS)
        total[:TERMS] += np.bincount(term, count, TERMS).astype(np.int64)
        df[TERMS] += passage[-1] + 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at]), pa.array(total[at])], names=["term", "df", "total"])


def _sketcher(idf, omega):
    def sketch(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        out, place = np.zeros((TERMS, SKETCH)), np.zeros(TERMS, np.int64)
        for passage, term, count in _passages(batches):
            value = count * idf[term]
            starts = np.flatnonzero(np.diff(passage, prepend=-1))
            row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(passage))))
            value /= np.sqrt(np.add.reduceat(value * value, starts))[row] + 1e-12
            for lo in range(0, len(starts), SKETCH_ROWS):
                # The passages' own terms as a dense matrix, which is small: two products.
                part = slice(starts[lo], starts[lo + SKETCH_ROWS] if lo + SKETCH_ROWS < len(starts) else len(passage))
                there = np.zeros(TERMS, bool)
                there[term[part]] = True
                own = np.flatnonzero(there)
                place[own] = np.arange(len(own))
                dense = np.zeros((row[part][-1] - lo + 1, len(own)), np.float32)
                dense[row[part] - lo, place[term[part]]] = value[part]
                out[own] += dense.T @ (dense @ omega[own])
        at = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), *[pa.array(out[at, j]) for j in range(SKETCH)]], names=["term", *[f"y{j}" for j in range(SKETCH)]]
        )

    return sketch


def fit_space(table: DataFrame):
    """Vectors of the terms, (TERMS, DIMS), and their idf: idf-weighted right singular vectors of the TF-IDF
    passage matrix, each dimension scaled to unit variance, less the corpus mean.

    A randomised SVD over all passages in one distributed pass: A'(A omega) is summed by term
    in Spark, and only that TERMS x SKETCH matrix, of fixed size, comes to the driver, where
    the Nystrom form gives the singular vectors and values.
    """
    import numpy as np

    counts = table.select("ids").mapInArrow(_document_counts, "term int, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    df, total = np.zeros(TERMS + 1), np.zeros(TERMS + 1)
    for term, a, b in counts.collect():
        df[term], total[term] = a, b
    if not df[TERMS]:
        return np.zeros((TERMS, DIMS), np.float32), np.zeros(TERMS, np.float32)
    idf = np.log((1 + df[TERMS]) / (1 + df[:TERMS])).astype(np.float32)
    omega = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, SKETCH)))[0].astype(np.float32)
    names = [f"y{j}" for j in range(SKETCH)]
    sums = (
        table.select("ids")
        .mapInArrow(_sketcher(idf, omega), "term int, " + ", ".join(f"{n} double" for n in names))
        .groupBy("term")
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    y = np.zeros((TERMS, SKETCH))
    for row in sums.collect():
        y[row[0]] = row[1:]
    shift = 1e-6 * np.linalg.norm(y)
    shifted = y + shift * omega
    core = omega.T @ shifted
    values, basis = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * values.max()
    u, s, _ = np.linalg.svd(shifted @ (basis[:, good] / np.sqrt(values[good])), full_matrices=False)
    strength = np.sqrt(np.maximum(s**2 - shift, 0))
    use = np.flatnonzero(strength > 1e-6 * strength.max())[:DIMS]
    vectors = np.zeros((TERMS, DIMS))
    vectors[:, : len(use)] = idf[:, None] * u[:, use] / strength[use]
    return (vectors - (total[:TERMS] / total[:TERMS].sum()) @ vectors).astype(np.float32), idf


def _width(n: int) -> int:
    """Words of a stretch that is held against an item of ``n`` words."""
    return n + max(2, n // 3)


def _finder(vectors, items: list[list[bytes]], min_cosine: float):
    """Candidates (item, lo, hi) of each text, in words.

    A text is cut into regions of two tiles, one tile apart, the tiles wide enough that every
    stretch of an item's width lies in a region whole. The latent windows of a region are
    compared with the items that a leak there is possible for at all: those of whose words the
    region holds enough.
    """
    import numpy as np

    ids = [term_ids(x) for x in items]
    kept = np.array([k for k, x in enumerate(items) if x], np.int64)
    sizes = np.array([len(x) for x in items], np.int64)
    least = np.ceil(COVER_WITH_ANSWER * sizes)
    terms = np.concatenate([ids[k] for k in kept]).astype(np.int64) if len(kept) else np.zeros(0, np.int64)
    begins = np.cumsum(sizes[kept]) - sizes[kept]
    tile = np.array([max(TILE, 1 << (_width(int(n)) - 1).bit_length()) for n in sizes], np.int64)
    unit = np.zeros((len(items), vectors.shape[1]), np.float32)
    for k in kept:
        q = vectors[ids[k]].sum(axis=0)
        unit[k] = q / (np.linalg.norm(q) + 1e-12)
    windows = [sorted({window_length(f * n + STEP / 2) for f in LENGTHS}) for n in sizes.tolist()]
    as_lists = [x.tolist() for x in ids]
    where = [places(x) for x in as_lists]
    number = np.zeros(TERMS, np.int64)
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])

    def regions(text):
        """(item, first tile) of the regions where enough of an item's words stand, whatever their order."""
        if not len(kept):
            return np.zeros((0, 2), np.int64)
        there = np.zeros(TERMS, np.uint8)
        there[text] = 1
        may = kept[np.add.reduceat(there[terms], begins, dtype=np.int64) >= least[kept]]
        found = [np.zeros((0, 2), np.int64)]
        for width in np.unique(tile[may]):
            mine = may[tile[may] == width]
            slots = np.concatenate([ids[k] for k in mine])
            wanted = np.zeros(TERMS, bool)
            wanted[slots] = True
            hit = np.flatnonzero(wanted[text])
            own = np.flatnonzero(wanted)
            number[own] = np.arange(len(own))
            tiles = np.zeros((-(-len(text) // width) + 1, len(own)), np.uint8)
            tiles[hit // width, number[text[hit]]] = 1
            held = (tiles[:-1] | tiles[1:])[:, number[slots]]
            enough = np.add.reduceat(held, np.cumsum(sizes[mine]) - sizes[mine], axis=1, dtype=np.int64) >= least[mine]
            r, c = np.nonzero(enough)
            found.append(np.stack([mine[c], r * width], axis=1))
        return np.concatenate(found)

    def near(texts: list) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, lo, hi) of the regions one of whose windows comes near the item."""
        each = [regions(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in each])
        if not len(owner):
            return
        item, lo = np.concatenate(each).T
        lengths = np.array([len(t) for t in texts])
        blocks = -(-lengths // STEP)
        ends = np.cumsum(blocks)
        row = np.full(ends[-1] * STEP, TERMS, np.int64)
        for t, e, n in zip(texts, ends, blocks, strict=True):
            row[(e - n) * STEP : (e - n) * STEP + len(t)] = t
        sums = np.zeros((ends[-1] + 1, padded.shape[1]))
        np.cumsum(padded[row].reshape(-1, STEP, padded.shape[1]).sum(axis=1), axis=0, out=sums[1:])
        close = np.zeros(len(owner), bool)
        for w in sorted({w for k in np.unique(item).tolist() for w in windows[k]}):
            with_w = np.flatnonzero(np.fromiter((w in windows[k] for k in item.tolist()), bool, len(item)))
            stride = max(STEP, w // PER_WINDOW // STEP * STEP)
            for at in range(0, len(with_w), PAIRS):
                part = with_w[at : at + PAIRS]
                # A window ends with its text; one that would begin in the next region is left to that.
                steps = np.arange(0, max(1, 2 * int(tile[item[part]].max()) - w + stride), stride) // STEP
                end = ends[owner[part]]
                a = np.minimum((end - blocks[owner[part]] + lo[part] // STEP)[:, None] + steps, end[:, None])
                window = sums[np.minimum(a + w // STEP, end[:, None])] - sums[a]
                dots = np.einsum("pjd,pd->pj", window, unit[item[part]])
                close[part] |= (dots >= np.sqrt(np.einsum("pjd,pjd->pj", window, window)) * min_cosine + 1e-9).any(axis=1)
        for k, m, a in zip(owner[close].tolist(), item[close].tolist(), lo[close].tolist(), strict=True):
            yield k, m, a, min(int(lengths[k]), a + 2 * int(tile[m]))

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            values, group, size, first = batch.column(2), [], 0, 0
            for at, value in enumerate(values):
                group.append(np.frombuffer(value.as_py(), np.uint16))
                size += len(group[-1])
                if size < BLOCK and at < len(values) - 1:
                    continue
                for k, item, lo, hi in near(group):
                    # Equal words have equal ids, so this bound can only be too high.
                    if lcs_length(as_lists[item], group[k][lo:hi].tolist(), where[item]) >= least[item]:
                        for column, x in zip(out, (batch.column(0)[first + k].as_py(), batch.column(1)[first + k].as_py(), item, lo, hi), strict=True):
                            column.append(x)
                group, size, first = [], 0, at + 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "th", "item", "lo", "hi"])

    return find


def covered(item: list[bytes], span: list[bytes], idf=None) -> tuple[bool, float, bool]:
    """Whether a stretch of ``span`` of about the item's length leaks ``item``, and, of the best
    such stretch or else of the best at all, the share of ``item`` in their longest common
    subsequence and whether the answer stands whole there. The share is no higher than that of
    the item's distinct words found there, weighted by ``idf`` (by hashed term; equal weights
    without it), so that words which are everywhere make no leak."""
    n, where = len(item), places(item)
    distinct = list(where)
    weight = dict(zip(distinct, [1.0] * len(distinct) if idf is None else idf[term_ids(distinct)].tolist(), strict=True))
    if (mass := sum(weight.values())) <= 0:
        weight, mass = dict.fromkeys(distinct, 1.0), len(distinct)
    width, best = _width(n), (False, 0.0, False)
    tail = item[-ANSWER:]
    for at in range(max(1, len(span) - width + 1)):  # every stretch: which is best must not depend on the span
        part = span[at : at + width]
        there = sum(weight[w] for w in set(part).intersection(weight)) / mass
        if there < best[1] and (best[0] or there < COVER_WITH_ANSWER):
            continue  # it can't be accepted, or not as well
        share = min(lcs_length(item, part, where) / n, there)
        whole = share >= COVER_WITH_ANSWER and any(part[k : k + len(tail)] == tail for k in range(len(part) - len(tail) + 1))
        best = max(best, (share >= COVER or whole, share, whole))
    return best


def _checker(items: list[list[bytes]], names: list, idf=None):
    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            spots = batch.column(2).to_pylist()
            for doc_id, value, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), spots, strict=True):
                words = tokens(value.as_py())
                for s in spans:
                    leaks, share, answer = covered(items[s["item"]], words[s["lo"] : s["hi"]], idf)
                    if leaks:
                        for column, x in zip(out, (doc_id, names[s["item"]], share, answer), strict=True):
                            column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "answer"])

    return check


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, item_id, coverage, answer): one row for each document and item that it leaks.

    Whole texts are turned into hashed term ids once; the latent space is fitted to all of their
    passages; windows of about an item's length and of 1.3 times it, a quarter apart, are compared
    with the items, wherever enough of an item's words stand together for a leak to be possible;
    what comes near is checked by longest common subsequence, on the ids first and then on the
    words themselves, and for the item's answer. Null and empty texts
    and items match nothing; repeated rows give one row; null ids return as null; extra columns
    are not read. A benchmark of any size is searched in slices that fit a worker.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("th"), "text")
    table = cut(texts.mapInArrow(_token_table, "doc_id long, th long, ids binary"))
    vectors, idf = fit_space(table)
    leaks: list[DataFrame] = []
    for names, items in _slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast((vectors, items, names, idf))
        find = lambda batches, shared=shared: _finder(*shared.value[:2], min_cosine)(batches)
        near = landed(table.mapInArrow(find, "doc_id long, th long, item int, lo int, hi int"))
        spots = near.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("item", "lo", "hi")).alias("spots"))
        spots = spots.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
        met = texts.join(spots, (texts["th"] == spots["_th"]) & texts["doc_id"].eqNullSafe(spots["_id"])).select("doc_id", "text", "spots")
        check = lambda batches, shared=shared: _checker(*shared.value[1:])(batches)
        leaks.append(met.mapInArrow(check, "doc_id long, item_id long, coverage double, answer boolean"))
    if not leaks:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, answer boolean")
    checked = functools.reduce(DataFrame.unionByName, leaks)
    return checked.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("answer").alias("answer"))


def _slices(benchmark: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, words) of the distinct items, in slices; the rows come one partition at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    names, items, size = [], [], 0
    for name, text in rows.sort("item_id", "text").toLocalIterator():
        if names and (len(names) >= SLICE_ITEMS or size + len(text) > SLICE_CHARS):
            yield names, items
            names, items, size = [], [], 0
        names.append(name)
        items.append(tokens(text.encode()))
        size += len(text)
    if names:
        yield names, items


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that leak an item, columns unchanged; rows without an id stay."""
    leaks = cut(find_leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).where("_leak is not null").distinct())
    return docs.join(leaks, docs["doc_id"] == leaks["_leak"], "left_anti")
