"""Count transducers and collocations: automata against dictionaries, phrases against SQL."""

import collections
import random

import duckdb
import numpy as np
import pytest

from tests.test_catalog import canonical
from windlass.llm import automata, collocations, oracles


def counted(seed, n=4000, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % vocabulary}é"[: rng.randint(2, 4)].encode() if rng.random() < 0.9 else b"." for _ in range(n)]
    brute = collections.Counter()
    for size in (1, 2, 3):
        for k in range(n - size + 1):
            if b"." not in words[k : k + size]:
                brute[tuple(words[k : k + size])] += 1
    numbers = collocations._Numbers({b".": 0})
    ids = np.array([numbers[w] for w in words])
    return automata.built(*collocations.grams_of(list(numbers), ids, 3)), brute


def said(labels, grams, counts):
    return {tuple(labels[k - 1] for k in g if k): c for g, c in zip(grams.tolist(), counts.tolist(), strict=True)}


def test_transducers_give_the_counts_and_share_states(monkeypatch):
    for rows in (1 << 17, 64):
        monkeypatch.setattr(automata, "ROWS", rows)
        made, brute = counted(1)
        assert said(made.labels, *automata.Transducer.load(made.dump()).entries()) == brute
        states = len(made.layers[2][0]) - 1
        assert states < len({w[:2] for w in brute if len(w) == 3})
        grams, _ = made.entries()
        assert [tuple(g) for g in grams.tolist()] == sorted(tuple(g) for g in grams.tolist())


def test_unions_and_compositions():
    (one, a), (two, b) = counted(2), counted(3, vocabulary=90)
    assert said(*automata.united([one, two])) == a + b
    grams, ours, theirs = one.compose(two)
    assert said(one.labels, grams, ours) == {k: v for k, v in a.items() if k in b}
    assert said(one.labels, grams, theirs) == {k: v for k, v in b.items() if k in a}
    for bounds in ([], [(b"", b""), (b"w1", b""), (b"w1", b"w2"), (b"w10", b"w1"), (b"w10", b"w3"), (b"w3", b"zz"), (b"x", b"y")]):
        ranges = {}
        for k, piece in one.pieces(bounds):
            ranges[k] = said(piece.labels, *automata.Transducer.load(piece.dump()).entries())
            assert len(piece.labels) == len({w for g in ranges[k] for w in g})
        assert {g: c for held in ranges.values() for g, c in held.items()} == a and sum(map(len, ranges.values())) == len(a)
        assert all(k == sum(x <= (*g, b"")[:2] for x in bounds) for k, held in ranges.items() for g in held)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 60}{rng.choice(['', '', '', ',', '.', '!'])}" for _ in range(rng.randint(1, 300))) for _ in range(150)]
    texts += [None, "", " ", ".,;", "New\tYork  City\nnew york city\x0bNEW York", "a b c d " * 30, "É é " * 20, "new york city " * 40, "new york times;" * 25, "x" * 70000 + " y z " * 12, "one two three " * 3000]
    return [(k, t, ("en", "de", None, "und")[k % 4], "p", 1, 2, 3) for k, t in enumerate(texts)] * 2


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, a long, range long, rank int").repartition(6)


def by_sql(rows, **settings):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    cursor = con.execute(oracles.collocations_sql(**settings))
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


def test_collocations_match_sql(spark, rows):
    made = collocations.collocations(frame(spark, rows))
    found = canonical(made.columns, [tuple(r) for r in made.collect()])
    assert found == by_sql(rows) and len(found) > 500
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(frame(spark, rows).limit(0)).count() == 0


def test_many_pieces_ranges_and_unions_change_nothing(spark, rows, monkeypatch):
    for name, value in (("HELD", 500), ("RANGE", 400), ("SAMPLE", 16), ("FAN", 3), ("BOUND", 2), ("SALTS", 3)):
        monkeypatch.setattr(collocations, name, value)
    made = collocations.collocations(frame(spark, rows[:170]), min_count=3, top=50)
    found = canonical(made.columns, [tuple(r) for r in made.collect()])
    assert found == by_sql(rows[:170], min_count=3, top=50) and len(found) > 100


def test_scores_of_huge_counts_are_exact(spark):
    a, l, r = 9_999_999_999_999_937, 9_999_999_999_999_999, 10_000_000_000_000_061
    from pyspark.sql import functions as F

    expr = "(CAST(1000000 AS DECIMAL(7,0)) * CAST(CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) AS DECIMAL(32,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(F.expr(expr)).first()[0] == 1_000_000 * a * a // (l * r)
