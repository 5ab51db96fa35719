"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments of 32 bits. For each segment the Hamming ball of radius one
around its value is enumerated; every (segment, value) of it is an entry. Two fingerprints that
differ in two bits or fewer within a segment share an entry of it. What meets in an entry is a
candidate, and the complete distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.llm.common import cut, keeping, landed
from windlass.llm.components import connected_components

#: Fingerprints of ``near_duplicates``: bits, words of a shingle, seed of its hash, and the
#: distance at which two link.
BITS, SHINGLE, SEED, MAX_DISTANCE = 64, 3, 42, 2
#: Bits of a segment. Two segments hold 64 bits, so that two fingerprints at a distance of two
#: always have a segment that differs in one bit at most.
SEGMENT = 32
#: An entry that more fingerprints share is crowded: its members are not compared pair by pair.
CROWD = 64
#: Fingerprints of ``similar_documents``: segments, words of a shingle, least Jaccard similarity.
WIDE, WORDS, SIMILAR = 12, 5, 0.8
#: Members of an entry up to which ``similar_documents`` compares all of them at once; of more, those
#: that can link at all are compared with one first and then only where this has not joined them.
WIDE_CROWD = 3
#: Times that sets without enough shared shingles are left out of what the others can share.
PRUNE = 2
#: Bits of a segment that are flipped in the ball: those whose vote was closest.
DOUBTS = 10
#: Differing bits of the wide fingerprint up to which texts are compared. Texts at similarity 0.8
#: differ in 58 of 384 bits on average, with a deviation of seven.
WIDE_DISTANCE = 90
_GRAM = "h long, key long, size long, reach long, mine long, root long, both long"
#: Shingles whose bits are counted at once; bounds a worker's memory on very long texts.
BLOCK = 1 << 15
#: Odd multipliers that make further hash values from one.
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93]


def _grams(words: list[bytes], n: int) -> Iterator[bytes]:
    """The shingles of ``n`` words, all words together if there are fewer."""
    return map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else iter([b" ".join(words)])


def _votes(hashes):
    """For each bit, how many of the 64-bit hashes set it: bytes are summed in blocks of 255."""
    import numpy as np

    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    votes = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        votes += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return votes


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the 3-word shingles of a UTF-8 text, every repeat counted.

    A-Z is lower-cased. A text of fewer than three words has one shingle, all of it; a null,
    empty or blank text has fingerprint zero.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    counts, n = np.zeros(BITS, np.int64), max(1, len(words) - SHINGLE + 1)
    for at in range(0, n, BLOCK):
        grams = _grams(words[at : at + BLOCK + SHINGLE - 1], SHINGLE) if len(words) >= SHINGLE else iter([b" ".join(words)])
        counts += _votes(np.array([xxh64_intdigest(g, SEED) for g in grams], np.uint64))
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document; texts go to Python in Arrow batches, nothing shuffles."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_fingerprints, "doc_id long, fp long")


def _thinned(entry, key, crowd: int = CROWD):
    """Sorted entries with their keys, at most ``crowd`` + 1 rows of each; and the keys in entries
    that have more. So a crowded entry is known as such however few of its rows are sent on."""
    import numpy as np

    order = np.lexsort((key, entry))
    entry, key = entry[order], key[order]
    first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
    size = np.diff(np.append(first, len(entry)))
    place = np.arange(len(entry)) - np.repeat(first, size)
    crowded = np.repeat(size > crowd, size)
    keep = place <= crowd
    return entry[keep], key[keep], entry[crowded], key[crowded]


def _probes(batches: Iterator) -> Iterator:
    """(entry, key) of 64-bit fingerprints, which are their own keys. Those in a crowd of this
    batch are named once each under a negative entry."""
    import numpy as np
    import pyarrow as pa

    flips = np.concatenate([[0], np.int64(1) << np.arange(SEGMENT)])
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            fp = np.asarray(batch.column(0).slice(at, BLOCK)).view(np.uint64)
            halves = [((fp >> np.uint64(SEGMENT * s)) & np.uint64(0xFFFFFFFF)).astype(np.int64) | s << SEGMENT for s in range(BITS // SEGMENT)]
            made = np.concatenate([(h[:, None] ^ flips).ravel() for h in halves])
            entry, key, _, crowd = _thinned(made, np.tile(np.repeat(fp.view(np.int64), len(flips)), len(halves)))
            crowd = np.unique(crowd)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([entry, _aside(crowd)])), pa.array(np.concatenate([key, crowd]))], names=["entry", "key"])


def _aside(keys):
    """Negative entries, which spread rows that only pass through the exchange."""
    return -1 - (keys & 0xFFFFF)


def _met(batches: Iterator, passing: list) -> Iterator:
    """Of rows sorted by entry, the keys of each entry that more than one has, as an array; rows
    under negative entries go to ``passing`` instead."""
    import numpy as np

    rest_entry, rest_key = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(entry, key):
        edges = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1], [True]]))
        size = np.diff(edges)
        for a, n in zip(edges[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
            yield key[a : a + n]

    for batch in batches:
        entry = np.asarray(batch.column(0))
        at = int(np.searchsorted(entry, 0))
        if at:
            passing.append(batch.slice(0, at))
        entry, key = np.concatenate([rest_entry, entry[at:]]), np.concatenate([rest_key, np.asarray(batch.column(1))[at:]])
        if len(entry):
            last = int(np.searchsorted(entry, entry[-1]))
            yield from split(entry[:last], key[:last])
            rest_entry, rest_key = entry[last:], key[last:]
    if len(rest_entry):
        yield from split(rest_entry, rest_key)


def _pairs(us: list, vs: list, crowd: list):
    """A batch (u, v) of distinct pairs, u above v, and of the members of crowds with v null."""
    import numpy as np
    import pyarrow as pa

    none = np.zeros(0, np.int64)
    u, v, alone = (np.concatenate([none, *x]) for x in (us, vs, crowd))
    pairs, alone = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0), np.unique(alone)
    for x in (us, vs, crowd):
        x.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([pairs[:, 0], alone])), pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, 1])), pa.nulls(len(alone), pa.int64())])], names=["u", "v"]
    )


def _compare(batches: Iterator) -> Iterator:
    """(u, v) of the fingerprints of an entry at a distance of two at most; (u, null) for each of a
    crowded entry."""
    import numpy as np

    us, vs, crowd, passing = [], [], [], []
    for keys in _met(batches, passing):
        if len(keys) > CROWD:
            crowd.append(keys)
        else:
            i, j = np.triu_indices(len(keys), 1)
            near = np.bitwise_count((keys[i] ^ keys[j]).view(np.uint64)) <= MAX_DISTANCE
            us.append(keys[j[near]])
            vs.append(keys[i[near]])
        if len(us) + len(crowd) > BLOCK:
            yield _pairs(us, vs, crowd)
    yield _pairs(us, vs, crowd + [np.asarray(b.column(1)) for b in passing])


def near_links(fps: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that join all those at 2 bits or less.

    Two tables, one for each half of the fingerprint: an entry is a half's value, and each
    fingerprint probes the Hamming ball of radius one around its own. Fingerprints that meet in
    an entry are compared on all bits. Crowded entries (a group of near copies shares a half) are
    not compared pair by pair; their members meet in a finer table, keyed by the probed half
    together with the other half. An entry there can have 65 members at most, two fingerprints at
    two bits or fewer always share one, and linking each to the smallest joins them all.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Fingerprints are few bytes and their entries many: spread them before they multiply, not by
    # key, as an exchange by "fp" that is there already would be taken and coalesced by its size.
    probes = fps.select("fp").repartition(parts).mapInArrow(_probes, "entry long, key long")
    met = landed(probes.repartition(parts, "entry").sortWithinPartitions("entry", "key").mapInArrow(_compare, "u long, v long"))
    crowd = met.where("v is null").select(F.col("u").alias("fp")).distinct()
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    balls = F.array(*[F.lit(x).cast("long") for x in [0, *[signed(1 << b) for b in range(BITS)]]])
    fine = crowd.select("fp", F.explode(balls).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("entry"))
    groups = fine.groupBy("entry").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    linked = groups.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where(
        (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE)
    )
    return met.where("v is not null").unionByName(linked.select("u", "v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Documents link where their fingerprints differ in two bits or fewer (empty texts share
    fingerprint zero). component_id is the smallest id reachable; null ids never win, and a
    component that has only those gets null. Repeated rows each return. Extra columns of
    ``docs`` are not read. Copies meet as one fingerprint before anything is compared.
    """
    signed = cut(fingerprints(docs, id_col, text_col))
    distinct = signed.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(near_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = rooted.join(named, "root").select("fp", "component_id")
    return signed.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: bytes | None, n: int = WORDS):
    """The distinct 64-bit hashes of a text's shingles of ``n`` words, sorted; none of a blank text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.fromiter(map(xxh3_64_intdigest, _grams(words, n)), np.uint64))


def wide_fingerprint(hashes):
    """(segments, doubts): the 32-bit segments of the SimHash of a set of shingles, and in each a
    mask of the ``DOUBTS`` bits whose vote was closest."""
    import numpy as np

    votes = np.zeros(WIDE * SEGMENT, np.int64)
    for at in range(0, len(hashes), BLOCK):
        h = hashes[at : at + BLOCK, None] * np.array(_MIX[: WIDE // 2], np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MIX[0])
        votes += _votes(h ^ (h >> np.uint64(29)))
    lead = (2 * votes - len(hashes)).reshape(WIDE, SEGMENT)
    low = np.argpartition(np.abs(lead), DOUBTS, axis=1)[:, :DOUBTS]
    return ((lead > 0) << np.arange(SEGMENT)).sum(axis=1), (np.int64(1) << low).sum(axis=1)


def _wide(batches: Iterator) -> Iterator:
    """(doc_id, key, segments, doubts): the key is a hash of the text's words, A-Z lower-cased."""
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = value.as_py() or b""
            segments, doubts = wide_fingerprint(shingle_hashes(text))
            key = xxh3_64_intdigest(b" ".join(text.lower().split()), SEED)
            for column, x in zip(out, (doc_id, key - (key >> 63 << 64), segments.tobytes(), doubts.tobytes()), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "key", "segments", "doubts"])


def _wide_entries(part):
    """(entry, key) of a batch (key, segments, doubts): the ball in every segment."""
    import numpy as np

    weights = np.int64(1) << np.arange(SEGMENT, dtype=np.int64)
    keys = np.asarray(part.column(0))
    segments, doubts = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.int64).reshape(len(keys), WIDE) for k in (1, 2))
    made = []
    for s in range(WIDE):
        row, bit = np.nonzero(doubts[:, s, None] & weights)
        base = segments[:, s] | s << SEGMENT
        made += [(base, keys), (base[row] ^ weights[bit], keys[row])]
    return (np.concatenate(x) for x in zip(*made, strict=True))


def _wide_probes(batches: Iterator) -> Iterator:
    """(entry, key): a row for each entry of each text, WIDE_CROWD + 1 for an entry in a batch at
    most. Those in an entry with more are named once each under a negative entry."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, len(batch), BLOCK // 4):
            entry, key, _, crowd = _thinned(*_wide_entries(batch.slice(at, BLOCK // 4)), WIDE_CROWD)
            crowd = np.unique(crowd)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([entry, _aside(crowd)])), pa.array(np.concatenate([key, crowd]))], names=["entry", "key"])


def _wide_pairs(batches: Iterator) -> Iterator:
    """(u, v) of the keys that meet in an entry, or (u, null) for each of a crowded one."""
    import numpy as np

    us, vs, crowd, passing = [], [], [], []
    for keys in _met(batches, passing):
        if len(keys) > WIDE_CROWD:
            crowd.append(keys)
        else:
            i, j = np.triu_indices(len(keys), 1)
            us.append(keys[i])
            vs.append(keys[j])
        if len(us) + len(crowd) > BLOCK:
            yield _pairs(us, vs, crowd)
    yield _pairs(us, vs, crowd + [np.asarray(b.column(1)) for b in passing])


def _wide_all(batches: Iterator) -> Iterator:
    """(entry, key, size, reach, weight, root): every entry of each text, with its other columns."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, len(batch), BLOCK // 4):
            part = batch.slice(at, BLOCK // 4)
            entry, place = _wide_entries(part.set_column(0, "key", pa.array(np.arange(len(part)))))
            place = pa.array(place)
            yield pa.RecordBatch.from_arrays([pa.array(entry), *[part.column(k).take(place) for k in (0, 3, 4, 5, 6)]], names=["entry", "key", *part.schema.names[3:]])


def _runs(batches: Iterator) -> Iterator:
    """Of rows of longs sorted by their first column, the other columns of each run of equal ones."""
    import numpy as np

    def split(rows):
        edges = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1], [True]]))
        return (rows[1:, a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    rest = None
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns])
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        last = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
        yield from split(rows[:, :last]) if last else ()
        rest = rows[:, last:]
    if rest is not None and rest.shape[1]:
        yield from split(rest)


def _to_centre(batches: Iterator) -> Iterator:
    """(key, centre, heavy): each member of an entry with its centre, the one of the greatest weight,
    and that weight; of the entries of a batch the heaviest centre of each."""
    import numpy as np
    import pyarrow as pa

    found, held = [], 0

    def best():
        key, centre, heavy = np.concatenate(found, axis=1)
        order = np.lexsort((centre, heavy, key))
        last = order[np.append(key[order][1:] != key[order][:-1], True)]
        return pa.RecordBatch.from_arrays([pa.array(x[last]) for x in (key, centre, heavy)], names=["key", "centre", "heavy"])

    for key, size, reach, weight, _ in _runs(batches):
        at = np.lexsort((key, weight))[-1]
        may = (key != key[at]) & (size <= reach[at]) & (size[at] <= reach)
        n = int(may.sum())
        found.append(np.stack([key[may], np.full(n, key[at]), np.full(n, weight[at])]))
        held += n
        if held > BLOCK or len(found) > BLOCK:
            yield best()
            found, held = [], 0
    if found:
        yield best()


def _across(batches: Iterator) -> Iterator:
    """(u, v): members of an entry that belong to different roots and reach each other."""
    import numpy as np

    us, vs, held = [], [], 0
    for rows in _runs(batches):
        # One whose reach ends below the least size meets none.
        key, size, reach, _, root = rows[:, rows[2] >= rows[1].min()]
        if not len(key) or (root == root[0]).all():
            continue
        for at in range(len(key) - 1):
            may = at + 1 + np.flatnonzero((root[at + 1 :] != root[at]) & (size[at + 1 :] <= reach[at]) & (size[at] <= reach[at + 1 :]))
            us.append(key[may])
            vs.append(np.full(len(may), key[at]))
            held += len(may)
            if held > BLOCK * 16 or len(us) > BLOCK:
                yield _pairs(us, vs, [])
                held = 0
    yield _pairs(us, vs, [])


def _outside(batches: Iterator) -> Iterator:
    """Of runs of one shingle: (u, v, of_u, of_v, least_u, least_v) of members that belong to different
    roots and reach each other, one of which has the shingle outside its centre. of_u counts the
    shingles outside u's centre that v has, least_u is how many a link takes; sums of many parts."""
    import numpy as np
    import pyarrow as pa

    found, held = [], 0

    def sums():
        rows = np.concatenate(found, axis=1)
        order = np.lexsort((rows[1], rows[0]))
        rows = rows[:, order]
        first = np.flatnonzero(np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))[: rows.shape[1]]
        counts = [np.add.reduceat(rows[k], first) if len(first) else rows[k] for k in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[0, first], rows[1, first], *counts, rows[4, first], rows[5, first])], names=["u", "v", "of_u", "of_v", "least_u", "least_v"])

    for rows in _runs(batches):
        stay = rows[2] >= rows[1].min()
        key, size, reach, mine, root, both = rows[:, stay]
        if not mine.any() or (root == root[0]).all():
            continue
        for at in np.flatnonzero(mine).tolist():
            may = np.flatnonzero((root != root[at]) & (size <= reach[at]) & (size[at] <= reach))
            one, none = np.ones(len(may), np.int64), np.zeros(len(may), np.int64)
            least = -(-4 * (size[may] + size[at]) // 9)
            own, other = (np.full(len(may), key[at]), one, least - both[at]), (key[may], none, least - both[may])
            up = own[0] > other[0]
            found.append(np.stack([np.where(up, x, y) for k in range(3) for x, y in ((own[k], other[k]), (other[k], own[k]))]))
            held += len(may)
            if held > BLOCK * 16 or len(found) > BLOCK:
                yield sums()
                found, held = [], 0
    if found:
        yield sums()


def _close(batches: Iterator) -> Iterator:
    """(u, v) of the pairs whose complete fingerprints are near enough."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(batch), WIDE) for k in (2, 3))
        yield batch.filter(pa.array(np.bitwise_count(a ^ b).sum(axis=1) <= WIDE_DISTANCE)).select([0, 1])


def _alike(batches: Iterator) -> Iterator:
    """(u, v) of the pairs whose texts' shingle sets are similar enough."""
    import pyarrow.compute as pc

    for batch in _overlaps(batches):
        yield batch.filter(pc.field("alike")).select([0, 1])


def _overlaps(batches: Iterator) -> Iterator:
    """(u, v, both, alike): the number of shingles that both have, and whether that is enough."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        shared, alike = [], []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(t.as_py(), np.uint64) for t in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            shared.append(both)
            alike.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(alike, pa.bool_())], names=["u", "v", "both", "alike"])


def _joined(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(u, v, a, b): ``pairs`` with a column of ``table`` for either end."""
    a, b = (table.select(F.col("key").alias(k), F.col(column).alias(name)) for k, name in (("u", "a"), ("v", "b")))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b")


def _spread(batches: Iterator) -> Iterator:
    """(h, key, ...): a row for each shingle of each set (key, hashes, centre's hashes, ...), with
    the other columns; in place of the centre, whether the shingle is outside it."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            sets, n, out = [], [], []
            for x, y in zip(part.column(1), part.column(2), strict=True):
                own = np.frombuffer(x.as_py(), np.int64)
                sets.append(own)
                n.append(len(own))
                out.append(~np.isin(own, np.frombuffer(y.as_py(), np.int64)) if y.is_valid else np.zeros(len(own), bool))
            place = pa.array(np.repeat(np.arange(len(part)), n))
            key, size, reach, root, both = (part.column(k).take(place) for k in (0, 3, 4, 5, 6))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets)), key, size, reach, pa.array(np.concatenate(out).astype(np.int64)), root, both], names=["h", "key", "size", "reach", "mine", "root", "both"]
            )


def _reach(shared: str) -> Column:
    """The largest size of a set that a set which shares that much at most can be similar enough to."""
    return F.floor((9 * F.col(shared) - 4 * F.col("size")) / 4)


def linkable(held: DataFrame) -> DataFrame:
    """(key, size, shared, weight, reach) of the sets of shingles (key, hashes) that can be similar enough to
    another of them: ``reach`` is the largest size such another one can have, ``weight`` the mean
    logarithm of how many sets have a shingle.

    Of a set, s shingles (``shared``) are in any other; it has 9 s >= 4 (size + other size) with each one at a
    similarity of 0.8, whose size is at least 0.8 of its own. Only counts by shingle and by key are
    made, so the work grows with the sets, not with their pairs or with the number of tasks. Logarithms
    are whole numbers (of 1024ths), whose sums are the same in any order.
    """
    none = F.lit(0).cast("long")
    for _ in range(PRUNE):
        grams = held.select("key", "hashes", F.lit(None).cast("binary").alias("centre"), *[none.alias(c) for c in ("size", "reach", "root", "both")])
        rows = grams.mapInArrow(_spread, _GRAM).select("key", F.count("*").over(Window.partitionBy("h")).alias("n"))
        sums = rows.groupBy("key").agg(F.count_if(F.col("n") == 1).alias("lone"), F.sum(F.round(1024 * F.log2("n")).cast("long")).alias("weight"))
        sized = held.select("key", (F.octet_length("hashes") / 8).cast("long").alias("size"))
        sized = sized.join(sums, "key")
        sized = sized.select("key", "size", (F.col("size") - F.col("lone")).alias("shared"), F.floor(F.col("weight") / F.col("size")).alias("weight"))
        found = landed(sized.withColumn("reach", _reach("shared")).where("5 * reach >= 4 * size"))
        held = held.join(found.select("key"), "key", "left_semi")
    return found


def _crowd_links(members: DataFrame, held: DataFrame, alike: DataFrame, parts: int) -> DataFrame:
    """(u, v): links among ``members`` of crowds (key, segments, doubts and the columns of
    ``linkable``), of which ``held`` has the shingles, so that with those in ``alike`` all that link
    to each other are joined.

    Each is compared with one first, the heaviest centre of its entries. A text that has o shingles
    in its centre shares o with any other at most, and those of its others that the other has. So
    two that are not joined yet are compared if o allows it for both, or with what each has outside
    its centre and the other has too. Pairs within a component are not made.
    """
    row = "entry long, key long, size long, reach long, weight long, root long"

    def entries(rows: DataFrame) -> DataFrame:
        made = rows.select("key", "segments", "doubts", "size", "reach", "weight", "root").mapInArrow(_wide_all, row)
        return made.repartition(parts, "entry").sortWithinPartitions("entry", "key")

    def compared(pairs: DataFrame) -> DataFrame:
        return landed(_joined(pairs, held, "hashes").mapInArrow(_overlaps, "u long, v long, both long, alike boolean"))

    centres = entries(members.withColumn("root", F.col("key"))).mapInArrow(_to_centre, "key long, centre long, heavy long")
    stars = compared(centres.groupBy("key").agg(F.max(F.struct("heavy", "centre")).alias("c")).select(F.col("key").alias("u"), F.col("c.centre").alias("v")))
    roots = connected_components(alike.unionByName(stars.where("alike").select("u", "v"))).withColumnRenamed("node", "key")
    to = stars.select(F.col("u").alias("key"), F.col("v").alias("centre"), "both")
    placed = members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).join(to, "key", "left")
    placed = landed(placed.withColumn("both", F.least("both", "shared")))  # of null and a number, the number
    direct = entries(placed.withColumn("reach", _reach("both"))).mapInArrow(_across, "u long, v long")
    other = held.select(F.col("key").alias("centre"), F.col("hashes").alias("other"))
    grams = placed.join(held, "key").join(other, "centre", "left").select("key", "hashes", "other", "size", "reach", "root", "both").mapInArrow(_spread, _GRAM)
    outside = grams.repartition(parts, "h").sortWithinPartitions("h", "key").mapInArrow(_outside, "u long, v long, of_u long, of_v long, least_u long, least_v long")
    outside = outside.groupBy("u", "v", "least_u", "least_v").agg(F.sum("of_u").alias("of_u"), F.sum("of_v").alias("of_v")).where("of_u >= least_u and of_v >= least_v")
    more = compared(direct.unionByName(outside.select("u", "v")).distinct())
    return stars.unionByName(more).where("alike").select("u", "v")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, component_id) of the rows of ``docs`` that have an id: documents link where the
    Jaccard similarity of their sets of 5-word shingles is 0.8 or more.

    ``key`` is a 64-bit hash of the text's words (A-Z lower-cased); texts of equal words are one
    text here, blank ones too. Candidates meet by multi-index hashing of a fingerprint of twelve
    32-bit segments: in each the ball of radius one over the ten bits with the closest votes is
    enumerated, as near copies differ in those first. The complete distance is checked, then the
    shingle sets themselves. Members of crowded entries are first held against what is shared at all
    (``linkable``), which leaves out those that can have no link to another member. The others are
    compared with a centre, and across the components that this makes wherever two can link at all
    (``_crowd_links``), so no link of those that meet is lost. component_id is the smallest id reachable.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = landed(texts.mapInArrow(_wide, "doc_id long, key long, segments binary, doubts binary"))
    firsts = landed(signed.groupBy("key").agg(F.min(F.struct("doc_id", "segments", "doubts")).alias("f")).select("key", F.col("f.doc_id").alias("first_id"), "f.segments", "f.doubts"))
    table = firsts.select("key", "segments", "doubts")
    probes = table.repartition(parts).mapInArrow(_wide_probes, "entry long, key long")
    met = landed(probes.repartition(parts, "entry").sortWithinPartitions("entry", "key").mapInArrow(_wide_pairs, "u long, v long"))

    def sets(keys: DataFrame) -> DataFrame:
        """(key, hashes) of some keys."""
        wanted = keys.join(firsts.select("key", "first_id"), "key")
        # Rows under one id can hold several texts: the key says which is meant.
        held = texts.join(wanted, texts["doc_id"] == wanted["first_id"]).select("key", "text").mapInArrow(_keyed_sets, "key long, hashes binary")
        return landed(held.dropDuplicates(["key"]))

    def verified(pairs: DataFrame) -> DataFrame:
        close = landed(_joined(pairs, table, "segments").mapInArrow(_close, "u long, v long"))
        wanted = close.select(F.col("u").alias("key")).distinct().union(close.select("v").distinct()).distinct()
        held = crowded.join(wanted, "key", "left_semi").unionByName(sets(wanted.join(crowd, "key", "left_anti")))
        return landed(_joined(close, held, "hashes").mapInArrow(_alike, "u long, v long"))

    crowd = landed(met.where("v is null").select(F.col("u").alias("key")).distinct())
    crowded = sets(crowd)
    may = linkable(crowded)

    # Pairs of two members of crowds are left to what follows.
    ends = crowd.select(F.col("key").alias("u"), F.lit(True).alias("in_u")), crowd.select(F.col("key").alias("v"), F.lit(True).alias("in_v"))
    pairs = met.where("v is not null").distinct().join(ends[0], "u", "left").join(ends[1], "v", "left").where("in_u is null or in_v is null").select("u", "v")
    close = landed(_joined(pairs, table, "segments").mapInArrow(_close, "u long, v long"))
    wanted = close.select(F.col("u").alias("key")).distinct().union(close.select("v").distinct()).distinct()
    held = crowded.join(wanted, "key", "left_semi").unionByName(sets(wanted.join(crowd, "key", "left_anti")))
    alike = landed(_joined(close, held, "hashes").mapInArrow(_alike, "u long, v long"))
    if not may.isEmpty():
        alike = alike.unionByName(_crowd_links(table.join(may, "key"), crowded, alike, parts))
    roots = landed(connected_components(alike))
    rooted = firsts.select("key", "first_id").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "first_id", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return signed.select("doc_id", "key").join(rooted.join(named, "root").select("key", "component_id"), "key").select("doc_id", "key", "component_id")


def _keyed_sets(batches: Iterator) -> Iterator:
    """(key, hashes) of the rows whose text has the key they are wanted for."""
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        keys, sets = [], []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = value.as_py() or b""
            own = xxh3_64_intdigest(b" ".join(text.lower().split()), SEED)
            if own - (own >> 63 << 64) == key:
                keys.append(key)
                sets.append(shingle_hashes(text).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "hashes"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of each group of similar ones, once each, columns
    unchanged. Rows without an id are kept: nothing names which of them is the copy."""

    def body(d: DataFrame) -> DataFrame:
        stay = similar_documents(d).select(F.col("component_id").alias("_keep")).distinct()
        named = d.join(stay, d["doc_id"] == stay["_keep"], "left_semi").dropDuplicates(["doc_id"])
        return named.unionByName(d.where(d["doc_id"].isNull()))

    return keeping(docs, ("key", "component_id"), body)
