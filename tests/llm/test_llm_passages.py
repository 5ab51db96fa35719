"""Suffix arrays against sorting, and repeated passages against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from windlass.llm import passages, suffixes


def test_suffix_arrays_and_prefixes_equal_brute_force(monkeypatch):
    for seed in range(150):
        rng = random.Random(seed)
        monkeypatch.setattr(suffixes, "STEP", rng.choice([1, 3, 64, 1 << 15]))
        monkeypatch.setattr(suffixes, "SHORT", rng.choice([2, 2, 20]))
        monkeypatch.setattr(suffixes, "BUCKET", rng.choice([0, 0, 3, 256]))
        text = [rng.randint(1, rng.choice([1, 2, 3, 5, 50, 400])) for _ in range(rng.randint(0, 120))]
        text = np.array(text * rng.choice([1, 3]) + [0])
        order = suffixes.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())  # noqa: B023
        shared = suffixes.permuted_prefixes(text, order, 1)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while text[a + n] == text[b + n] and text[a + n] > 1:
                n += 1
            assert shared[b] == n


def brute(rows):
    """By (doc_id, digest): (n_bytes, n_removed, n_spans, digest of what is left)."""
    texts = {(d, hashlib.sha256(t).digest()): t for d, t in rows if d is not None}
    seen, made = set(), {}
    for key in sorted(texts):
        text, gone = texts[key], bytearray(len(texts[key]))
        for k in range(len(text) - 99):
            w = text[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        made[key] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((-1, len(t), 0, 0, hashlib.sha256(t).hexdigest()) if d is None else (d, *made[d, hashlib.sha256(t).digest()]) for d, t in rows)


def prose(rng, n):
    return " ".join(f"{rng.choice('bcdfgß')}{rng.choice('aeiouü')}{rng.randint(0, 400)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    shared = [prose(rng, n) for n in (30, 16, 60, 200)]
    edge = prose(rng, 40).encode()[:100].decode("utf-8", "ignore")
    texts = []
    for _ in range(160):
        parts = [prose(rng, rng.randint(0, 60)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, 3), edge)
        if rng.random() < 0.1:
            parts.append(rng.choice(shared)[17:170])
        texts.append(" ".join(parts))
    near = texts[4].split(" ")
    for k in range(12):
        near[rng.randrange(len(near))] = "other"
        texts.append(" ".join(near))
    texts += [texts[9]] * 25 + ["-" * 700, "ab" * 300, "x" * 99, "x" * 100, "y" * 101, None, "", " ", "\n" * 250, "é" * 50, "é" * 51, prose(rng, 20_000) + shared[2]]
    texts = [*enumerate(texts)]
    return [*texts, (3, texts[3][1]), (3, texts[3][1]), (7, texts[8][1]), (5, "another text " * 30), (None, texts[9][1]), (None, None)]


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "x", 5) for d, t in rows], "doc_id long, text string, shard long, th string, first long").repartition(7)
    made = passages.repeated_passages(docs).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in made)
    assert found == brute([(d, (t or "").encode()) for d, t in rows])
    assert all(sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in made)
    return docs


def test_passages_equal_brute_force(spark, rows):
    docs = check(spark, rows)
    assert passages.repeated_passages(docs.limit(0)).count() == 0
    assert passages.repeated_passages(docs.where("doc_id is null or text is null")).count() == 3


def test_many_groups_buckets_and_slices_change_nothing(spark, rows, monkeypatch):
    for name, value in (("TEXTS", 30_000), ("ANCHORS", 900), ("SUFFIXES", 20_000), ("SLICE", 256), ("SEEN", 20), ("CROWD", 3)):
        monkeypatch.setattr(passages, name, value)
    check(spark, [r for r in rows if len(r[1] or "") < 20_000])


def test_texts_of_a_group_are_hashed_together(monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(18, 90)).encode() for _ in range(60)] + [b"-" * 300, b"ab" * 200, b"x" * 100, b"x" * 100]
    ends = np.cumsum([len(x) for x in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    for k in (passages.ANCHOR, passages.MEETING):
        apart = [passages.window_runs(np.frombuffer(x, np.uint8), k, look=True) for x in texts]
        apart = [(h, e - len(x) + a, e - len(x) + b, twice) for x, e, runs in zip(texts, ends.tolist(), apart, strict=True) for h, a, b, twice in zip(*(y.tolist() for y in runs), strict=True)]
        assert list(zip(*(y.tolist() for y in passages.window_runs(joined, k, look=True, ends=ends)), strict=True)) == apart
    wide = {a for _, first, end, _ in apart for a in range(first, end)}
    calls, own = [], passages.hashes
    monkeypatch.setattr(passages, "hashes", lambda *a: calls.append(1) or own(*a))
    monkeypatch.setattr(passages, "SLICE", 256)
    made = passages.window_runs(joined, look=True, ends=ends)
    assert {a for first, end in zip(made[1].tolist(), made[2].tolist(), strict=True) for a in range(first, end)} == wide
    assert len(calls) == -(-(len(joined) - passages.WIDTH + 1) // 256)


def test_a_bucket_of_many_shards_is_searched_once():
    import time

    taken = {}
    for shards in (8, 800):
        rng = np.random.default_rng(3)
        values = rng.integers(0, 1 << 62, 300_000, dtype=np.uint64)
        parts = [np.unique(x) for x in np.array_split(np.concatenate([values, values[:100_000]]), shards)]
        more = [x[::50] for x in parts]
        once = [x[np.arange(len(x)) % 50 > 0] for x in parts]
        table = pa.table({"bucket": [0] * shards, "shard": range(shards), "once": [passages._packed(x) for x in once], "more": [passages._packed(x) for x in more]})
        began = time.process_time()
        made = passages._repeated(table)
        taken[shards] = time.process_time() - began
        times = Counter(np.concatenate(parts).tolist())
        every = set(np.concatenate(more).tolist())
        found = {s: passages._unpacked(x, np.uint64).tolist() for s, x in zip(made["shard"].to_pylist(), made["repeated"].to_pylist(), strict=True)}
        assert {s: sorted(x) for s, x in found.items()} == {s: y for s, x in enumerate(parts) if (y := [v for v in x.tolist() if times[v] > 1 or v in every])}
        assert made["n"].to_pylist() == [len(x) for x in found.values()] and not any(made["n_crowded"].to_pylist())
    # The same values in a hundred times as many shards: before, a search among all for each shard.
    assert taken[800] < 8 * taken[8] + 0.2


def test_long_texts_in_one_window_run(spark):
    check(spark, [(1, "a" * 400_000), (2, "a" * 300_000), (3, None)])
