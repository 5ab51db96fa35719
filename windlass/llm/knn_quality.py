"""Quality by nearest-neighbour voting in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import fold, keeping

#: Hashed terms of each view of a text: byte trigrams, runs of letter shapes, recency of words.
VIEWS = (1 << 12, 1 << 10, 32)
TERMS = sum(VIEWS)
#: Latent dimensions; labelled documents the model is fitted on and votes with, at most.
DIMS, MAX_LABELLED = 64, 3000
NEIGHBOURS, SHARPNESS = 25, 8.0
#: Scores from here up predict label 1.
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_CHUNK, _ROWS = 1 << 20, 256
_HASH = 0x9E3779B97F4A7C15
#: Shape of a byte: lower-case and other scripts' letters, upper case, digits, marks as they are.
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def _ngrams(a, n: int, buckets: int):
    """Counts of the hashed runs of ``n`` bytes."""
    import numpy as np

    counts = np.zeros(buckets, np.int64)
    for at in range(0, len(a) - n + 1, _CHUNK):
        part = a[at : at + _CHUNK + n - 1].astype(np.uint64)
        code = part[: len(part) - n + 1]
        for k in range(1, n):
            code = code << np.uint64(8) | part[k : len(part) - n + 1 + k]
        counts += np.bincount((code * np.uint64(_HASH) >> np.uint64(65 - buckets.bit_length())).astype(np.int64), minlength=buckets)
    return counts


def features(text: bytes | None):
    """Counts of the terms of three views of a text, all of it: byte trigrams; runs of four signs
    of its letter shapes (repeats of a shape drawn together, as in ``Aa, a.``); and for each word
    how long ago it stood last, in powers of two (or that it is new)."""
    import numpy as np

    text = text or b""
    raw, shape = np.frombuffer(text, np.uint8), np.frombuffer(text.translate(_SHAPE), np.uint8)
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ((shape[1:] != 97) & (shape[1:] != 65) & (shape[1:] != 48))
    ago, last = [0] * VIEWS[2], {}
    for at, word in enumerate(text.split()):
        ago[(at - last[word]).bit_length() if word in last else 0] += 1
        last[word] = at
    return np.concatenate([_ngrams(raw, 3, VIEWS[0]), _ngrams(shape[keep], 4, VIEWS[1]), ago]).astype(np.float32)


def _weighted(x, idf):
    """TF-IDF rows, in place: each view of unit length, so that none drowns the others, then the whole."""
    import numpy as np

    edges = np.cumsum([0, *VIEWS])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        x[:, a:b] *= idf[a:b]
        _normal(x[:, a:b])
    return _normal(x)


def packed(counts) -> bytes:
    """A vector of counts as the places and values that are not zero."""
    import numpy as np

    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.float32).tobytes()


def unpacked(rows: list[bytes]):
    """The matrix of packed vectors; what the driver gets is their few terms, not the matrix."""
    import numpy as np

    out = np.zeros((len(rows), TERMS), np.float32)
    for k, row in enumerate(rows):
        n = len(row) // 6
        out[k, np.frombuffer(row, np.uint16, n)] = np.frombuffer(row[2 * n :], np.float32)
    return out


def _vectors(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        values = batch.column(2).cast(pa.binary())
        for at in range(0, len(values), _ROWS):
            made = [packed(features(x.as_py())) for x in values[at : at + _ROWS]]
            part = batch.slice(at, _ROWS)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], names=["doc_id", "label", "vector"])


def labelled_sample(docs: DataFrame, labels: DataFrame, at_most: int = MAX_LABELLED) -> list:
    """(doc_id, label, vector) of the labelled training documents whose id hashes are least,
    ``at_most`` of them. Held-out ids never enter; rows without label or id are left out; an id
    labelled more than once has the label most of its rows have, 1 on a tie."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where(
        F.col("doc_id").isNotNull() & F.col("q").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = usable.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label"))
    chosen = known.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    vectors = rows.mapInArrow(_vectors, "doc_id long, label int, vector binary")
    return vectors.orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(at_most).collect()


def _normal(x):
    """Rows of length one, in place."""
    import numpy as np

    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + np.float32(1e-12)
    return x


def fit(sample: list) -> dict:
    """idf, projection, labelled unit vectors, labels and the share of label 1."""
    import numpy as np

    if not sample:
        return {"labels": np.zeros(0, np.float32), "prior": 0.5}
    x = unpacked([s["vector"] for s in sample])
    labels = np.array([s["label"] for s in sample], np.float32)
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + np.float32(0.1)
    x = _weighted(x, idf)
    # Randomised SVD with two power steps, of a matrix whose size the bounds above fix.
    start = np.random.default_rng(3).standard_normal((x.shape[1], DIMS + 8)).astype(np.float32)
    basis = np.linalg.qr(x @ start)[0]
    for _ in range(2):
        basis = np.linalg.qr(x @ (x.T @ basis))[0]
    project = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:DIMS].T.copy()
    return {"idf": idf, "project": project, "vectors": _normal(x @ project), "labels": labels, "prior": float(labels.mean())}


def vote(model: dict, x):
    """Scores of rows of features: exact cosines with all labelled vectors in one product, the
    nearest ones' labels weighted by a power of their similarity."""
    import numpy as np

    n = len(model["labels"])
    if not n:
        return np.full(len(x), model["prior"])
    cos = _normal(_weighted(np.array(x, np.float32), model["idf"]) @ model["project"]) @ model["vectors"].T
    k = min(NEIGHBOURS, n)
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(x), 1))
    weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(axis=1)
    score = np.divide((weight * model["labels"][near]).sum(axis=1), total, out=np.full(len(x), model["prior"]), where=total > 1e-9)
    return np.clip(score, 0.0, 1.0)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score (0 to 1, higher for label 1) and predicted, every row kept in place.

    The model is fitted on at most ``MAX_LABELLED`` labelled documents outside the held-out
    fold and broadcast, as its size is fixed; scoring is one pass over whole texts, without a
    shuffle. Only the text is read: no label, id, language or source. A null or empty text is
    scored too (with the labelled share of 1, nothing being near). Without any label all score
    0.5. Columns named score or predicted are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels)))

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            found = [vote(shared.value, np.stack([features(x.as_py()) for x in texts[at : at + _ROWS]])) for at in range(0, len(texts), _ROWS)]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    kept = docs.drop("score", "predicted")
    kept = kept.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    scored = kept.mapInArrow(score, f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out() -> Column:
    return fold(F.col("doc_id"), FOLDS) == HELD_OUT


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` predicted to have label 1, columns unchanged, whatever their names."""
    return keeping(docs, ("score", "predicted"), lambda d: score_documents(d, labels).where("predicted = 1"))
