"""Suffix-array dedup: bytes covered by a string of WIDTH bytes that starts earlier, too.

Whole texts are never sorted against each other. Each window of WIDTH bytes belongs to an anchor,
the least hash of ANCHOR bytes inside it, so equal windows share their anchor. Anchors that stand
only once in the corpus have no repeated window; the windows of the others meet in shards, by the
least hash of MEETING bytes in them: shorter, so that more windows in a row go to one place, and
the bytes they reach over are sent there once. A shard sorts the suffixes of what it holds by induced
sorting, and permuted common prefixes tell which windows are equal, by their bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.lineage import cut_by
from windlass.llm.common import landed
from windlass.llm.suffixes import permuted_prefixes, suffix_array

#: Bytes of a string that counts as repeated, of the hashes that anchor it, and of those it is dealt by.
WIDTH, ANCHOR, MEETING = 100, 50, 20
#: Bytes of text that are handled together, anchors of a bucket, bytes of a shard of suffixes, places
#: hashed at once, texts that a task remembers, and texts groups an anchor may be in before its
#: windows are counted one by one.
TEXTS, ANCHORS, SUFFIXES, SLICE, SEEN, CROWD = 6 << 20, 2_000_000, 4 << 20, 1 << 18, 500_000, 64

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STOP = 0  # between texts of a shard; bytes are moved up by one


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SLICE + WIDTH), _powers(pow(_BASE, -1, 1 << 64), SLICE + WIDTH)


def hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` bytes in a row, the same wherever they stand."""
    sums = np.zeros(len(text) + 1, _U)
    np.cumsum((text.astype(_U) + _U(1)) * _UP[: len(text)], out=sums[1:])
    x = (sums[k:] - sums[:-k]) * _DOWN[: len(text) - k + 1]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(by)
    return x ^ (x >> _U(31))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    reach = 1
    while reach * 2 <= width:
        x, reach = np.minimum(x[:-reach], x[reach:]), reach * 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


def _fitting(at: int, n: int, ends: np.ndarray) -> np.ndarray:
    """Which of the ``n`` windows from ``at`` on reach over none of ``ends``."""
    near = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + n + WIDTH - 2, "right")] - at
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(near - WIDTH + 1, 0), 1)
    np.add.at(change, np.minimum(near, n), -1)
    return np.cumsum(change[:-1]) == 0


def window_runs(text: np.ndarray, k: int = ANCHOR, look: bool = False, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, end, again): runs of neighbouring windows that share their anchor; windows
    start from ``start`` to ``end`` - 1, and ``again`` says, with ``look``, that the anchor stands in
    the run more than once. ``ends`` are the ends of texts that stand one after the other in
    ``text``; no window reaches from one into the next. Taken in slices that overlap by a window."""
    made, reach = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))], WIDTH - k + 1
    for at in range(0, len(text) - WIDTH + 1, SLICE):
        own = hashes(text[at : at + SLICE + WIDTH - 1], k)
        least = _least(own, reach)
        fits = np.ones(len(least), bool) if ends is None else _fitting(at, len(least), ends)
        first = np.concatenate([[0], np.flatnonzero((least[1:] != least[:-1]) | (fits[1:] != fits[:-1])) + 1])
        end, kept = np.append(first[1:], len(least)), fits[first]
        first, end = first[kept], end[kept]
        anchor, again = least[first], np.zeros(len(first), bool)
        if look:
            # An anchor that comes into the window, or leaves it, stands at its end; else look for it.
            before, after = np.where(first > 0, least[first - 1], _U(0)), np.where(end < len(least), least[np.minimum(end, len(least) - 1)], _U(0))
            left, right, inside = first + reach - 1, end - 1, sliding_window_view(own, reach)
            x, y = np.flatnonzero(before <= anchor), np.flatnonzero(after <= anchor)
            left[x] = first[x] + (inside[first[x]] == anchor[x, None]).argmax(axis=1)
            right[y] = end[y] - 1 + reach - 1 - (inside[end[y] - 1, ::-1] == anchor[y, None]).argmax(axis=1)
            again = left != right
        made.append((anchor, at + first, at + end, again))
    return tuple(map(np.concatenate, zip(*made, strict=True)))


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpacked(held: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(held), kind)


def _texts(shards: int):
    """(shard, doc_id, th, held): each different text of a task that a window fits, compressed; again
    only if it comes with a smaller id."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        seen: dict[bytes, int] = {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = value.as_py() or b""
                if doc_id is None or len(text) < WIDTH:
                    continue
                digest = hashlib.sha256(text).digest()
                if seen.get(digest, doc_id + 1) <= doc_id:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen[digest] = doc_id
                for column, x in zip(out, (int.from_bytes(digest[:8]) % shards, doc_id, digest, zstandard.compress(text, 1)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "doc_id", "th", "held"])

    return rows


class _Shard:
    """The texts of a shard, in order of (doc_id, th), one of each digest, with its least id; ``text``
    has them one after the other, and they end at ``ends``."""

    def __init__(self, table):
        import zstandard

        rows = sorted(zip(table["doc_id"].to_pylist(), table["th"].to_pylist(), table["held"], strict=True), key=lambda r: r[:2])
        known, self.ids, self.digests, texts = set(), [], [], []
        for doc_id, th, held in rows:
            if th not in known:
                known.add(th)
                self.ids.append(doc_id)
                self.digests.append(th)
                texts.append(zstandard.decompress(held.as_py()))
        self.ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        self.starts = np.append(np.zeros(1, np.int64), self.ends[:-1])[: len(texts)]
        self.text = np.frombuffer(b"".join(texts), np.uint8)


def _buckets(shard: int, found: np.ndarray, times: np.ndarray, buckets: int):
    """Rows (bucket, shard, once, more): different hashes of a shard, by bucket; ``once`` are those
    that it has once."""
    import pyarrow as pa

    number = (found % _U(buckets)).astype(np.int64)
    order = np.argsort(number, kind="stable")
    edges = np.flatnonzero(np.diff(number[order], prepend=-1))
    made = [(int(number[p[0]]), found[p[times[p] == 1]], found[p[times[p] > 1]]) for p in np.split(order, edges[1:])] if len(found) else []
    return pa.table({"bucket": pa.array([b for b, _, _ in made], pa.int64()), "shard": pa.array([shard] * len(made), pa.int64()), "once": pa.array([_packed(x) for _, x, _ in made], pa.binary()), "more": pa.array([_packed(x) for _, _, x in made], pa.binary())})


_BUCKETS = "bucket long, shard long, once binary, more binary"


def _repeated(table):
    """Of the hashes of a bucket, for each shard that has them: those found in more than one place,
    and of these those that more than CROWD shards have."""
    import pyarrow as pa

    once = [_unpacked(x, _U) for x in table["once"].to_pylist()]
    more = [_unpacked(x, _U) for x in table["more"].to_pylist()]
    # All in order, once: a search for each shard among all would grow with the square of the shards.
    pieces = [*once, *more]
    every = np.concatenate(pieces)
    order = np.argsort(every)
    first = np.flatnonzero(np.append(True, every[order[1:]] != every[order[:-1]]) if len(every) else np.zeros(0, bool))
    shards = np.diff(first, append=len(every))
    seen_more = np.arange(len(every)) >= sum(map(len, once))
    kept, crowd = np.empty(len(every), bool), np.empty(len(every), bool)
    kept[order] = np.repeat((shards > 1) | np.logical_or.reduceat(seen_more[order], first) if len(every) else shards > 1, shards)
    crowd[order] = np.repeat(shards > CROWD, shards)
    edges = np.cumsum([len(x) for x in pieces])[:-1]
    kept, crowd = np.split(kept, edges), np.split(crowd, edges)
    out = []
    for k, shard in enumerate(table["shard"].to_pylist()):
        both = [(pieces[x][kept[x]], pieces[x][crowd[x]]) for x in (k, len(once) + k)]
        own, crowded = (np.concatenate(x) for x in zip(*both, strict=True))
        if len(own):
            out.append((shard, own, crowded))
    return pa.table({"shard": pa.array([s for s, _, _ in out], pa.int64()), "n": pa.array([len(x) for _, x, _ in out], pa.int64()), "repeated": pa.array([_packed(x) for _, x, _ in out], pa.binary()), "n_crowded": pa.array([len(x) for _, _, x in out], pa.int64()), "crowded": pa.array([_packed(x) for _, _, x in out], pa.binary())})


_REPEATED = "shard long, n long, repeated binary, n_crowded long, crowded binary"


def _joined(table, name: str) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, _U), *(_unpacked(x, _U) for x in table[name].to_pylist())]))


def _in(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``held``, which is sorted."""
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def _anchors(buckets: int):
    """The anchors of a shard's texts, each once, by bucket."""

    def body(table):
        held = _Shard(table)
        anchor, _, _, again = window_runs(held.text, look=True, ends=held.ends)
        found = [anchor, anchor[again]]
        return _buckets(table["shard"][0].as_py(), *np.unique(np.concatenate(found), return_counts=True), buckets)

    return body


def _marked(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places are in one of the runs, which have no place in common."""
    change = np.zeros(n + 1, np.int8)
    change[start] += 1
    change[end] -= 1
    return np.cumsum(change[:-1], dtype=np.int8).view(bool)


def _whole_windows(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The hashes of the windows that start where ``wanted`` says."""
    out = [np.zeros(0, _U)]
    for a in range(0, len(text) - WIDTH + 1, SLICE):
        own = wanted[a : min(a + SLICE, len(text) - WIDTH + 1)]
        if own.any():
            out.append(hashes(text[a : a + SLICE + WIDTH - 1], WIDTH)[own])
    return np.concatenate(out)


def _crowded_windows(buckets: int):
    """The hashes of whole windows of the anchors that a crowd of shards has, by bucket."""

    def body(table, said):
        crowded, found = _joined(said, "crowded"), np.zeros(0, _U)
        if len(crowded):
            held = _Shard(table)
            anchor, start, end, _ = window_runs(held.text, ends=held.ends)
            x = _in(anchor, crowded)
            found = _whole_windows(held.text, _marked(len(held.text), start[x], end[x]))
        shard = table["shard"][0].as_py() if len(table) else 0
        return _buckets(shard, *np.unique(found, return_counts=True), buckets)

    return body


def _contexts(shards: int):
    """Rows (bucket, shard, held): of each run of windows that may repeat, its place and bytes for the
    shard of suffixes it is dealt to; a run of the same bytes earlier in this group of texts
    settles it, and such runs come back as bucket -1. A row's values are packed as one, as with many
    groups and shards few runs go from one to the other."""

    def body(table, said):
        import pyarrow as pa

        anchors = said["kind"].to_numpy() == 0 if len(said) else np.zeros(0, bool)
        repeated, crowded = _joined(said.filter(pa.array(anchors)), "repeated"), _joined(said.filter(pa.array(anchors)), "crowded")
        windows = _joined(said.filter(pa.array(~anchors)), "repeated")
        held, seen, copies, made = _Shard(table), set(), [], {}
        if len(repeated):
            text = held.text
            anchor, start, end, _ = window_runs(text, ends=held.ends)
            x, y = _in(anchor, repeated), _in(anchor, crowded)
            kept = _marked(len(text), start[x], end[x])
            if y.any():  # only those that stand elsewhere as well
                among = _marked(len(text), start[y], end[y])
                kept[among] = _in(_whole_windows(text, among), windows)
            spans = _spans(kept)
            size = spans[:, 1] - spans[:, 0] + WIDTH - 1
            raw_ends = np.cumsum(size)
            raw = np.concatenate([text[:0], *(text[a : b + WIDTH - 1] for a, b in spans.tolist())])
            meeting, start, end, again = window_runs(raw, MEETING, look=True, ends=raw_ends)
            of = np.searchsorted(raw_ends, start, "right")
            at = start - (raw_ends - size)[of] + spans[of, 0]
            number = np.searchsorted(held.ends, at, "right")
            raw = raw.tobytes()
            runs = (number, at - held.starts[number], meeting.view(np.int64), (meeting % _U(shards)).astype(np.int64), start, end + WIDTH - 1, again)
            for k, first, h, place, a, b, twice in zip(*(x.tolist() for x in runs), strict=True):
                bytes_ = raw[a:b]
                if bytes_ in seen:
                    copies.append((k, first, first + b - a))
                else:
                    seen.add(bytes_)
                    made.setdefault(place, []).append((k, first, bytes_, h, twice))
        shard = table["shard"][0].as_py() if len(table) else 0
        out = [(-1, shard, _packed(np.array(copies, np.int64).reshape(-1, 3)))]
        for bucket, rows in made.items():
            at = np.array([(held.ids[k], a, len(x), h, twice, k) for k, a, x, h, twice in rows], np.int64)
            parts = (np.int64(len(rows)).tobytes(), at.tobytes(), *(held.digests[r[0]] for r in rows), *(r[2] for r in rows))
            out.append((bucket, shard, _packed(np.frombuffer(b"".join(parts), np.uint8))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "shard", "held"])

    return body


_CONTEXTS = "bucket long, shard long, held binary"


def repeated_windows(pieces: list[bytes]) -> np.ndarray:
    """(piece, first, past the last) of the runs of windows that stand earlier, in their piece or in
    one before it; ``pieces`` are in the order of their places. Suffixes in order, windows are equal where neighbours share WIDTH bytes."""
    if not pieces:
        return np.zeros((0, 3), np.int64)
    size = np.array([len(x) for x in pieces], np.int64)
    text = np.frombuffer(b"\n".join(pieces) + b"\n\n", np.uint8).astype(np.int16) + 2
    first = np.cumsum(size + 1) - size - 1
    text[first + size] = 1
    text[-1] = 0
    present = np.bincount(text) > 0  # numbers without gaps, for the least type
    text = (np.cumsum(present) - 1).astype(np.uint8 if present.sum() < 256 else np.int16)[text]
    order = suffix_array(text)
    equal = permuted_prefixes(text, order, 1)[order] >= WIDTH
    group = np.cumsum(~equal)
    least = np.minimum.reduceat(order, np.flatnonzero(np.diff(group, prepend=-1)))
    later = np.zeros(len(text), bool)
    later[order] = least[group - group[0]] < order
    runs = _spans(later)  # what is no whole window of a piece shares too little with any other
    of = np.searchsorted(first, runs[:, 0], "right") - 1
    return np.column_stack([of, runs - first[of, None]])


def _spans(windows: np.ndarray) -> np.ndarray:
    """(first, past the last) of the runs of true windows."""
    return np.flatnonzero(np.diff(np.concatenate([[False], windows, [False]]).astype(np.int8))).reshape(-1, 2)


def _sorted_shard(table):
    """Rows (shard, spans): for each group of texts, (text, first, past the last) of the bytes to
    remove that this shard of suffixes knows of."""
    import pyarrow as pa

    rows = []
    for shard, held in zip(table["shard"].to_pylist(), table["held"].to_pylist(), strict=True):
        own = _unpacked(held, np.uint8)
        n = int(own[:8].view(np.int64)[0])
        digests = 8 + 48 * n
        at, raw = own[8:digests].view(np.int64).reshape(n, 6), own.tobytes()
        end = (digests + 32 * n + np.cumsum(at[:, 2])).tolist()
        rows += [(d, raw[digests + 32 * k : digests + 32 * k + 32], a, shard, number, raw[e - s : e], h, twice) for k, ((d, a, s, h, twice, number), e) in enumerate(zip(at.tolist(), end, strict=True))]
    rows.sort(key=lambda r: r[:3])
    seen, kept, spans, runs = set(), [], {}, Counter()
    for r in rows:
        if r[5] in seen:  # the same bytes at an earlier place
            spans.setdefault(r[3], []).append((r[4], r[2], r[2] + len(r[5])))
        else:
            seen.add(r[5])
            kept.append(r)
            runs[r[6]] += 1
    # Windows are equal only under one hash: a run that is alone under its hash and no longer than what
    # one place of it reaches has nothing to be compared with.
    kept = [r for r in kept if runs[r[6]] > 1 or r[7]]
    for k, a, b in repeated_windows([r[5] for r in kept]).tolist():
        r = kept[k]
        spans.setdefault(r[3], []).append((r[4], r[2] + a, r[2] + b + WIDTH - 1))
    return pa.table({"shard": pa.array(list(spans), pa.int64()), "spans": pa.array([_packed(np.array(v, np.int64).reshape(-1, 3)) for v in spans.values()], pa.binary())})


def _cleaned(table, said):
    """(th, n_removed, n_spans, kept_sha256, spans) of each text of a group with repeats."""
    import pyarrow as pa

    held = _Shard(table)
    spans = np.concatenate([np.zeros((0, 3), np.int64), *(_unpacked(x, np.int64).reshape(-1, 3) for x in said["spans"].to_pylist())])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    touched, first = np.unique(spans[:, 0], return_index=True)
    out: list[list] = [[] for _ in range(5)]
    for k, own in zip(touched.tolist(), np.split(spans, first[1:]) if len(touched) else (), strict=True):
        text = held.text[held.starts[k] : held.ends[k]]
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, own[:, 1], 1)
        np.add.at(change, own[:, 2], -1)
        gone = np.cumsum(change)[:-1] > 0
        runs = _spans(gone)
        for column, x in zip(out, (held.digests[k], int(gone.sum()), len(runs), hashlib.sha256(text[~gone].tobytes()).hexdigest(), runs.tolist()), strict=True):
            column.append(x)
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["th", "n_removed", "n_spans", "kept_sha256", "spans"])


_CLEANED = "th binary, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"


def _found(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(th, n_removed, n_spans, kept_sha256, spans) of each different text with repeats, at its
    first place."""
    size = firsts.where(F.col("n_bytes") >= WIDTH).agg(F.sum("n_bytes")).first()[0] or 0
    # No fewer groups than a shuffle has tasks: Spark then leaves the texts where they are.
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXTS))
    texts = cut_by(docs.mapInArrow(_texts(groups), "shard long, doc_id long, th binary, held binary"), groups, "shard")
    by_group = texts.groupBy("shard")
    buckets = max(1, -(-2 * size // ((WIDTH - ANCHOR) * ANCHORS)))
    repeated = landed(by_group.applyInArrow(_anchors(buckets), _BUCKETS).groupBy("bucket").applyInArrow(_repeated, _REPEATED))
    n, crowded = repeated.agg(F.sum("n"), F.sum("n_crowded")).first()
    said = repeated.withColumn("kind", F.lit(0))
    if crowded:
        windows = by_group.cogroup(repeated.groupBy("shard")).applyInArrow(_crowded_windows(buckets), _BUCKETS)
        said = said.unionByName(landed(windows.groupBy("bucket").applyInArrow(_repeated, _REPEATED)).withColumn("kind", F.lit(1)))
    # A run of windows is about half of what may share a hash, and reaches over a window more.
    shards = max(1, -(-(n or 0) * (WIDTH - ANCHOR) * 2 * WIDTH // ((WIDTH - MEETING) * SUFFIXES)))
    contexts = landed(by_group.cogroup(said.groupBy("shard")).applyInArrow(_contexts(shards), _CONTEXTS))
    sorted_ = contexts.where("bucket >= 0").groupBy("bucket").applyInArrow(_sorted_shard, "shard long, spans binary")
    spans = contexts.where("bucket < 0").select("shard", F.col("held").alias("spans")).unionByName(sorted_)
    return by_group.cogroup(spans.groupBy("shard")).applyInArrow(_cleaned, _CLEANED)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row per row of ``docs``: what
    is left without the bytes that a string of WIDTH bytes covers which also starts earlier, in a
    text of a smaller id or before it in the same one. ``spans`` are the removed (first, past the
    last) bytes.

    A null or empty text has no bytes. Rows without an id keep all of theirs and take nothing from
    others. Repeated rows (the same id and text) are one document; texts that share an id are in
    the order of their digests. Texts are read whole, whatever their length, other columns not at
    all; an empty table gives no rows. Jobs run while this is called: the texts, once each, are
    checkpointed by group, anchors and window runs are landed.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keys = landed(read.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("th")))
    firsts = keys.where("doc_id is not null").groupBy("th", "n_bytes").agg(F.min("doc_id").alias("first"))
    found = landed(_found(read, firsts))
    known = firsts.select("th", "first").join(found, "th", "left")
    rows = keys.join(known, "th", "left")
    copied = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= WIDTH)
    own = F.col("doc_id").isNotNull() & F.col("n_removed").isNotNull()
    pick = lambda copy, mine, none: F.when(copied, copy).when(own, mine).otherwise(none)
    return rows.select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit("").cast("binary"), 256), F.col("kept_sha256"), F.lower(F.hex("th"))).alias("kept_sha256"),
        pick(F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes"))), F.col("spans"), F.array().cast("array<array<long>>")).alias("spans"),
    )
