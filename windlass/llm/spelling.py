"""Spelling variants: words one edit apart, found through broadcast Bloom filters.

Every word makes all its deletions and replacements, as hashes only; those that the blocked
Bloom filter of their length lets through become strings and meet the vocabulary in an exact
join. An insertion is the deletion of the other word, so it needs no probe of its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import landed

#: The letters of a word after lower-casing; all of its edits are made of these.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
MODULUS, MIN_LENGTH, MIN_COUNT, RATIO = 199, 6, 5, 5
#: Different words that a task counts before it hands its counts on.
HELD = 500_000
#: Filters: bits of a block, bits set by a word, bits given to a word, bytes of all filters at most
#: (what is broadcast; with more words they let more through, and the join decides as before),
#: and the length from which all words share a filter.
BLOCK, SET, PER_WORD, MAX_BYTES, LONGEST = 512, 5, 16, 1 << 26, 40
#: Edits that are hashed at once in a task.
EDITS = 2_000_000

_U = np.uint64
_RUN = re.compile("[a-zÀ-ÿ]+")
_PLACE = np.full(256, 255, np.uint8)
_PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def _word_counts(batches: Iterator) -> Iterator:
    """(word, n) of what a task has read, in bounded pieces."""
    import pyarrow as pa

    counts: Counter = Counter()
    sent = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(_RUN.findall((value.as_py() or b"").lower().decode("utf-8", "replace"))).items():
                size = len(run)
                if size >= MIN_LENGTH:
                    h = zlib.crc32(run.encode(), start)
                    if h % MODULUS == 0:
                        run = run[: h % size] + run[h % size + 1 :]
                    if len(run) >= MIN_LENGTH:
                        counts[run] += n
            if len(counts) >= HELD:
                yield sent()
                counts.clear()
    yield sent()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of ``docs`` with at least ``min_count`` occurrences."""
    read = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = read.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(_U)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(by)
    return x ^ (x >> _U(31))


def _keys(length: int) -> np.ndarray:
    """A random number of each letter at each place; a word's hash is their exclusive or."""
    return _mixed(np.arange(1, length * len(LETTERS) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(length, -1)


def _places(words: list[str], length: int) -> np.ndarray:
    """The letters' numbers of ``words``, all of ``length``, a row for each."""
    return _PLACE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(-1, length)


def _hashes(places: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(_keys(places.shape[1])[np.arange(places.shape[1]), places], axis=1)


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(blocks) >> _U(32)).astype(np.int64)


def _bits(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th bit, from 0, that a hash sets in its block."""
    return (hashes if k == 0 else _mixed(hashes + _U(k // 7)) >> _U(9 * (k % 7))) & _U(BLOCK - 1)


def shard_of(length: int) -> int:
    return min(length, LONGEST)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        found.setdefault(len(w), []).append(k)
    return found


def build_filters(words: DataFrame) -> dict[int, np.ndarray]:
    """By shard of length: blocks of 8 numbers of 64 bits. A word falls into one block, so blocks
    are united by key with map-side combining; all of them together have at most MAX_BYTES."""
    sizes = {r["shard"]: r["n"] for r in words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("shard")).agg(F.count("*").alias("n")).collect()}
    wanted = {s: math.ceil(n * PER_WORD / BLOCK) for s, n in sizes.items()}
    share = min(1.0, MAX_BYTES / (BLOCK // 8) / max(1, sum(wanted.values())))
    blocks = {s: max(1, int(n * share)) for s, n in wanted.items()}

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held = batch.column(0).to_pylist()
            for length, own in _by_length(held).items():
                h = _hashes(_places([held[k] for k in own], length))
                at, masks = _block_of(h, blocks[shard_of(length)]), np.zeros((len(h), BLOCK // 64), _U)
                for k in range(SET):
                    bit = _bits(h, k)
                    masks[np.arange(len(h)), (bit >> _U(6)).astype(int)] |= _U(1) << (bit & _U(63))
                columns = [pa.array(np.full(len(h), shard_of(length), np.int32)), pa.array(at), *[pa.array(c) for c in masks.view(np.int64).T]]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "at", *[f"b{k}" for k in range(BLOCK // 64)]])

    parts = [f"b{k}" for k in range(BLOCK // 64)]
    kinds = "shard int, at long, " + ", ".join(f"{b} long" for b in parts)
    made = words.select("word").mapInArrow(rows, kinds).groupBy("shard", "at").agg(*[F.bit_or(b).alias(b) for b in parts]).toArrow()
    filters = {s: np.zeros((n, len(parts)), _U) for s, n in blocks.items()}
    shard, at = made["shard"].to_numpy(), made["at"].to_numpy()
    values = np.stack([made[b].to_numpy() for b in parts], axis=1).astype(np.int64, copy=False).view(_U) if len(shard) else np.zeros((0, len(parts)), _U)
    for s, held in filters.items():
        held[at[shard == s]] = values[shard == s]
    return filters


def _passing(filters: dict[int, np.ndarray], length: int, hashes: np.ndarray) -> np.ndarray:
    """Places in ``hashes`` of words of ``length`` that the filter does not rule out."""
    held = filters.get(shard_of(length))
    if held is None:
        return np.zeros(0, np.int64)
    left = np.arange(len(hashes))
    for k in range(SET):
        h = hashes[left]
        bit = _bits(h, k)
        left = left[held[_block_of(h, len(held)), (bit >> _U(6)).astype(np.int64)] >> (bit & _U(63)) & _U(1) > 0]
    return left


def probes(words: list[str], filters: dict[int, np.ndarray]) -> Iterator[tuple[int, str]]:
    """(place in ``words``, edit): deletions and replacements that the filters let through."""
    for length, own in _by_length(words).items():
        keys, step = _keys(length), max(1, EDITS // (length * len(LETTERS)))
        for first in range(0, len(own), step):
            part = own[first : first + step]
            places = _places([words[k] for k in part], length)
            each = keys[np.arange(length), places]  # of a word, a place
            whole = np.bitwise_xor.reduce(each, axis=1)
            replaced = (whole[:, None, None] ^ each[:, :, None]) ^ keys[None]
            for x in _passing(filters, length, replaced.ravel()).tolist():
                k, rest = divmod(x, length * len(LETTERS))
                at, letter = divmod(rest, len(LETTERS))
                w = words[part[k]]
                if letter != places[k, at]:
                    yield part[k], w[:at] + LETTERS[letter] + w[at + 1 :]
            if filters.get(shard_of(length - 1)) is None:
                continue
            # Without its letter at a place, what follows moves one place to the left.
            moved = np.zeros_like(each)
            moved[:, 1:] = keys[np.arange(length - 1), places[:, 1:]]
            before = np.bitwise_xor.accumulate(each, axis=1) ^ each
            after = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1] ^ moved
            shorter = before ^ after
            same = np.zeros(shorter.shape, bool)
            same[:, 1:] = places[:, 1:] == places[:, :-1]  # the same word again
            for x in _passing(filters, length - 1, shorter.ravel()).tolist():
                k, at = divmod(x, length)
                if not same[k, at]:
                    w = words[part[k]]
                    yield part[k], w[:at] + w[at + 1 :]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of a vocabulary (word, n): both directions of each pair that differs
    by exactly one inserted, deleted or replaced code point."""
    filters = words.sparkSession.sparkContext.broadcast(build_filters(words))

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found = list(probes(held, filters.value))
            own = [k for k, _ in found]
            yield pa.RecordBatch.from_pydict({"word": pa.array([held[k] for k in own], pa.string()), "n": pa.array(n[own] if own else [], pa.int64()), "near": pa.array([e for _, e in found], pa.string())})

    edits = words.select("word", "n").mapInArrow(rows, "word string, n long, near string")
    pairs = landed(edits.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"))
    inserted = pairs.where(F.length("near") < F.length("word")).select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(inserted)


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each step follows as many forms as all steps before. A form
    has several times the count of its word, so there are no rings and few steps."""
    ways = landed(links.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further = landed(ways.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        ways = further.select("word", "root")
        if further.where("moved").isEmpty():
            return ways


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least six letters and ``min_count``
    occurrences: its near word of largest count if that has ``ratio`` times its own (ties: the
    smallest in code-point order), and the last word that forms lead to.

    Null and empty texts have no words; a null id is the empty text in the hash; repeated rows
    count as often as they stand; texts are read whole, whatever their length; other columns are
    not read. An empty table gives no rows. Jobs run while this is called: the vocabulary, its
    filters and its pairs are landed in the checkpoint folder.
    """
    words = landed(vocabulary(docs, id_col, text_col, min_count))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = landed(near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")))
    forms = near.select("word", "n_near", *[F.when(F.col("best.near_n") >= ratio * F.col("n"), F.col(f"best.{a}")).alias(b) for a, b in (("near", "form"), ("near_n", "form_n"))])
    roots = _roots(forms.where("form is not null"))
    return (
        words.join(forms, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
