"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

A scan of induced sorting over few, large buckets goes through the array in runs of slots that
induce nothing into themselves, so that a run is one array step; within a bucket that induces into
itself a step is all that the step before has put there. Over many small buckets, as reduced texts
have them, it goes slot by slot.
"""

from __future__ import annotations

import numpy as np

#: Slots that a scan tries to take in one step, the length up to which ranks are doubled instead, and
#: the slots of a bucket, on average, under which a scan goes slot by slot.
STEP, SHORT, BUCKET = 1 << 15, 1 << 12, 256


def _smallest(text: np.ndarray, top: int) -> np.ndarray:
    return text.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int32 if top < 1 << 31 else np.int64)


def _kind(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


def _put(slots: np.ndarray, edge: np.ndarray, way: int, suffixes: np.ndarray, buckets: np.ndarray) -> None:
    """Append ``suffixes``, in their order, to the ``edge`` of their buckets, to the right (way 1)
    or to the left (way -1)."""
    order = buckets.argsort(kind="stable")
    held = buckets[order]
    new = np.empty(len(held), bool)
    new[0] = True
    np.not_equal(held[1:], held[:-1], out=new[1:])
    first = new.nonzero()[0]
    size = np.empty_like(first)
    size[:-1], size[-1] = first[1:] - first[:-1], len(held) - first[-1]
    at = held[first].astype(np.int64)
    slots[way * np.arange(len(held)) + np.repeat(edge[at] - way * first, size)] = suffixes[order]
    edge[at] += way * size


def _scan_by_slot(slots: np.ndarray, text: np.ndarray, wanted: np.ndarray, edge: np.ndarray, way: int) -> None:
    # By suffix: the bucket of the one before it, if that is to be put; none for an empty slot, -1.
    bucket = np.full(len(slots) + 1, -1, np.int64)
    bucket[1:-1] = np.where(wanted[:-1], text[:-1].astype(np.int64), -1)
    held, edges, bucket = slots.tolist(), edge.tolist(), bucket.tolist()
    for j in held if way == 1 else reversed(held):  # what is put ahead is met later on
        c = bucket[j]
        if c >= 0:
            held[edges[c]] = j - 1
            edges[c] += way
    slots[:] = held


def _scan(slots: np.ndarray, text: np.ndarray, wanted: np.ndarray, char: np.ndarray, starts: np.ndarray, way: int) -> None:
    """Put each suffix whose type is ``wanted`` beside the heads (way 1, from the left) or tails
    (way -1, from the right) of its bucket, in the order of the suffixes that follow them."""
    n = len(slots)
    edge = starts[:-1].copy() if way == 1 else starts[1:] - 1
    if n < BUCKET * len(edge):
        _scan_by_slot(slots, text, wanted, edge, way)
        return
    at, step = (0, STEP) if way == 1 else (n - 1, STEP)
    while 0 <= at < n:
        end = min(n, at + step) if way == 1 else max(-1, at - step)
        own = int(char[at])
        ready = int(edge[own])  # of this bucket, what has been induced ends here
        block = slots[at:end] if way == 1 else slots[at : (end if end >= 0 else None) : -1]
        place = (block > 0).nonzero()[0]
        before = block[place] - 1
        kept = wanted[before]
        place, before = place[kept], before[kept]
        buckets = text[before]
        taken = abs(end - at)
        if len(before):
            nearest = int(buckets.min() if way == 1 else buckets.max())
            if nearest == own:  # the bucket induces into itself: take what it holds by now
                taken = abs(ready - at)
                if taken > len(block):
                    block = slots[at:ready] if way == 1 else slots[at : (ready if ready >= 0 else None) : -1]
                    before = block[block > 0] - 1
                    before = before[wanted[before]]
                    buckets = text[before]
                else:
                    before, buckets = before[place < taken], buckets[place < taken]
            else:
                last = int(char[end - way])
                if nearest <= last if way == 1 else nearest >= last:  # stop where it would induce into the run
                    taken = abs(int(starts[nearest] if way == 1 else starts[nearest + 1] - 1) - at)
                    before, buckets = before[place < taken], buckets[place < taken]
            if len(before):
                _put(slots, edge, way, before, buckets)
        step = min(STEP, 2 * step) if taken >= step else max(64, 2 * taken)
        at += way * taken


def _induced(text: np.ndarray, smaller: np.ndarray, starts: np.ndarray, char: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller ones in the order given."""
    slots = np.full(len(text), -1, _kind(len(text)))
    tails = starts[1:] - 1
    _put(slots, tails.copy(), -1, lms[::-1], text[lms[::-1]])
    _scan(slots, text, ~smaller, char, starts, 1)
    kept = slots[0]
    slots[smaller[slots] & (slots >= 0)] = -1
    slots[0] = kept  # the end of the text
    _scan(slots, text, smaller, char, starts, -1)
    slots[0] = kept
    return slots


def _pieces(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges that start at ``first``, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _doubled(text: np.ndarray) -> np.ndarray:
    """Suffixes of a short text by sorting pairs of ranks, twice as far apart each time."""
    rank, reach, n = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, len(text)
    while True:
        later = np.full(n, -1, np.int64)
        later[: n - reach] = rank[reach:]
        key = rank * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], key[order][1:] != key[order][:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        reach *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order. Its last number must be 0 and the only one."""
    n = len(text)
    if n <= SHORT:
        return _doubled(text)
    top = int(text.max())
    text = _smallest(text, top)
    # A suffix is smaller than the next if the next different number to its right is larger.
    turns = np.flatnonzero(text[:-1] != text[1:])
    smaller = np.zeros(n, bool)
    smaller[: n - 1] = np.repeat(text[turns] < text[turns + 1], np.diff(turns, prepend=-1))
    smaller[-1] = True
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
    char = np.repeat(np.arange(top + 1, dtype=text.dtype), np.diff(starts))
    found = _induced(text, smaller, starts, char, lms)
    # Names of the pieces between neighbours, by order; equal pieces share a name.
    number = np.full(n, -1, _kind(n))
    number[lms] = np.arange(len(lms))
    ordered = found[number[found] >= 0]
    size = np.append(np.diff(lms) + 1, 1)[number[ordered]]
    same = np.zeros(len(ordered), bool)
    pairs = np.flatnonzero(size[1:] == size[:-1])
    if len(pairs):
        equal = text[_pieces(ordered[pairs], size[pairs])] == text[_pieces(ordered[pairs + 1], size[pairs])]
        same[pairs + 1] = np.logical_and.reduceat(equal, np.cumsum(size[pairs]) - size[pairs])
    names = np.cumsum(~same) - 1
    if same.any():
        reduced = np.empty(len(lms), _kind(n))
        reduced[number[ordered]] = names
        ordered = lms[suffix_array(reduced)]
    return _induced(text, smaller, starts, char, ordered)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """Of each suffix, in text order: how long a prefix it shares with the one before it in
    ``order``; ``stop`` equals nothing.

    Only where the two are preceded by different numbers is the prefix compared; from one place
    to the next it otherwise loses one.
    """
    n = len(text)
    before = np.full(n, -1, _kind(n))
    before[order[1:]] = order[:-1]
    here = np.arange(n, dtype=_kind(n))
    known = (before > 0) & (here > 0)
    chained = np.zeros(n, bool)
    chained[known] = (text[here[known] - 1] == text[before[known] - 1]) & (text[here[known] - 1] != stop)
    free = np.flatnonzero(~chained & (before >= 0))
    shared = np.zeros(n, _kind(n))
    width, left, done = 16, free, np.zeros(len(free), np.int64)
    padded = np.concatenate([text, np.full(width, stop, text.dtype)])
    while len(left):
        reach = np.arange(width)
        a, b = padded[np.minimum(left + done, n)[:, None] + reach], padded[np.minimum(before[left] + done, n)[:, None] + reach]
        unequal = (a != b) | (a == stop)
        ended = unequal.any(axis=1)
        shared[left[ended]] = done[ended] + unequal[ended].argmax(axis=1)
        left, done = left[~ended], done[~ended] + width
    # A chained place takes the value of the last free one, less the way from it.
    source = np.maximum.accumulate(np.where(chained, -1, here))
    return np.where(chained, np.maximum(shared[source] - (here - source), 0), shared)
