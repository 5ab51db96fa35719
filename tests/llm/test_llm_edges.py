"""Null ids and texts, empty and very long texts, repeated rows, empty tables and clashing columns,
for the operators that learn or search."""

import math
import random

from windlass.llm import decontaminate, knn_quality, line_dedup, lm, mixing, simhash
from windlass.llm.queries import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, score double, row long, ids binary, h long, item int, label int, vector binary, tokens long, th long, at int"


def awkward(spark, extra=()):
    rng = random.Random(21)
    long = "\n".join(" ".join(f"w{rng.randint(0, 999)}" for _ in range(20)) for _ in range(6000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "a b"), (None, None), (4, " \n\t "), (5, long), *extra]
    return long, spark.createDataFrame([(k, t, None, "s", 0.5, 1, b"x", 2, 3, 4, b"y", 5, 6, 7) for k, t in rows], SCHEMA)


def by_id(rows):
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    return found


def test_lm_scores_awkward_rows(spark):
    long, docs = awkward(spark)
    found = by_id(lm.score_documents(docs, RANKS).collect())
    assert {k: len(v) for k, v in found.items()} == {1: 2, 2: 1, 3: 1, None: 2, 4: 1, 5: 1}
    assert found[1][0] == found[1][1] and found[5][0].n_tokens == len(long.split()) + 1
    assert {r.n_tokens for k in (2, 3, 4) for r in found[k]} == {1} and len({r.score for k in (2, 3, 4) for r in found[k]}) == 1
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for v in found.values() for r in v)
    assert lm.score_documents(docs.limit(0), RANKS).count() == 0


def test_leaks_of_awkward_rows(spark):
    item = "where does the quick brown fox of the story jump over lazy dogs"
    long, docs = awkward(spark, [(6, f"said {item} twice"), (6, f"said {item} twice"), (None, item)])
    long_leak = spark.createDataFrame([(7, f"{long} {item} {long}", None, "s", 0.5, 1, b"x", 2, 3, 4, b"y", 5, 6, 7)], SCHEMA)
    bench = spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string")
    found = decontaminate.find_leaks(docs.unionByName(long_leak), bench).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in found) == [(-1, 0), (6, 0), (7, 0)]
    kept = decontaminate.drop_leaks(docs.unionByName(long_leak), bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2


def test_mixing_quality_and_copies_of_awkward_rows(spark):
    _, docs = awkward(spark)
    mixed = by_id(mixing.mix(docs).collect())
    assert sum(map(len, mixed.values())) == 8 and mixed[1][0].sampled == mixed[1][1].sampled and mixed[2][0].tokens == 0
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored = by_id(knn_quality.score_documents(docs, labels).collect())
    assert sum(map(len, scored.values())) == 8 and scored[1][0].score == scored[1][1].score and all(0 <= r.score <= 1 for v in scored.values() for r in v)
    groups = by_id(simhash.similar_documents(docs).collect())
    assert {k: {r.component_id for r in v} for k, v in groups.items()} == {1: {1}, 2: {2}, 3: {2}, 4: {2}, 5: {5}}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 2, 5]
    cleaned = line_dedup.dedup_lines(docs)
    assert cleaned.columns == docs.columns and sorted((r.doc_id or -1, len(r.text or "")) for r in cleaned.collect()) == sorted((r.doc_id or -1, len(r.text or "")) for r in docs.collect())
