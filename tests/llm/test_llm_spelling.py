"""Spelling variants against brute force, with awkward rows and a filter too small to say no."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from windlass.llm import spelling


def brute_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    words, made = brute_words(rows), {}
    for w, n in words.items():
        found = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = found[0][1] if found and -found[0][0] >= 5 * n else None
        made[w] = (form, n, len(found), -found[0][0] if form else None)
    out = {}
    for w, (form, n, k, m) in made.items():
        root = w
        while made[root][0]:
            root = made[root][0]
        out[w] = (form, root, n, k, m)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = ["garden", "gardens", "gardener", "silver", "sliver", "élèves", "éleves", "banana", "bananna", "bananas", "straße÷n", "STRAÃÜEN", "mississippi"]
    base += ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(60)]
    weights = [1 / (1 + k % 17) for k in range(len(base))]
    texts = [" ".join(w if rng.random() < 0.8 else w.upper() for w in rng.choices(base, weights, k=40)) for _ in range(120)]
    chain = ["abcdef " * 5, "abcdeff " * 25, "abcdefff " * 130, "abcdefffg " * 700]
    long = "q" * 3000
    return [*enumerate([*texts, *chain, f"{long} " * 6 + f"{long}q " * 40, None, "", "1 2 3", "x\ty"]), (3, texts[3]), (3, texts[3]), (None, texts[5])]


def test_variants_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(k, t, "w", 1, "r") for k, t in rows], "doc_id long, text string, word string, n long, root string").repartition(5)
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
    wanted = brute(rows)
    assert found == wanted and any(v[0] for v in wanted.values()) and wanted["abcdef"][1] == "abcdefffg"
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_small_filters_change_nothing(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows[:60], "doc_id long, text string")
    words = spelling.vocabulary(docs).cache()
    wanted = sorted(map(tuple, spelling.near_words(words).collect()))
    monkeypatch.setattr(spelling, "MAX_BYTES", 64)
    assert sorted(map(tuple, spelling.near_words(words).collect())) == wanted and wanted


def test_filters_rule_most_edits_out(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice(spelling.LETTERS) for _ in range(rng.randint(6, 12))) for _ in range(3000)})
    filters = spelling.build_filters(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    for w in words[:200]:
        assert len(spelling._passing(filters, len(w), spelling._hashes(spelling._places([w], len(w))))) == 1
    edits = sum(len(w) * len(spelling.LETTERS) for w in words)
    assert len(list(spelling.probes(words, filters))) < edits / 100
    assert sum(f.nbytes for f in filters.values()) <= spelling.MAX_BYTES
    assert np.unique(spelling._hashes(spelling._places(["silver", "sliver", "livers"], 6))).size == 3
