"""Weighted acyclic automata over words: count transducers of n-grams.

A transducer reads the words of an n-gram and gives the number on its last arc. Its states lie in
layers by the words read so far; arcs of a state are sorted by label, and labels are numbered
from 1 in byte order. Two prefixes that go on alike, counts included, share a state.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left

import numpy as np

#: N-grams are rows of word numbers, 0 after the last word; so prefixes sort before what they begin.
Rows = tuple[np.ndarray, np.ndarray]


def order_of(grams: np.ndarray, base: int) -> np.ndarray:
    """Places of ``grams`` in order; ``base`` is above every number in them."""
    if base ** grams.shape[1] < 1 << 63:
        key = np.zeros(len(grams), np.int64)
        for column in grams.T:
            key = key * base + column
        return np.argsort(key, kind="stable")
    return np.lexsort(grams.T[::-1])


def summed(grams: np.ndarray, counts: np.ndarray, base: int) -> Rows:
    """Each n-gram once, in order, with the sum of its counts."""
    if not len(grams):
        return grams, counts
    order = order_of(grams, base)
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)]))
    return grams[first], np.add.reduceat(counts, first)


class Transducer:
    """``labels`` and, for each layer, (start, label, count, target): the arcs of state s are those
    from start[s] to start[s + 1]; target is a state of the next layer, or -1."""

    def __init__(self, labels: list[bytes], layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.labels, self.layers = labels, layers

    def dump(self) -> bytes:
        import zstandard

        least = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0)))) if x.min(initial=0) >= 0 else x
        return zstandard.compress(pickle.dumps((self.labels, [tuple(map(least, a)) for a in self.layers]), 5), 1)

    @staticmethod
    def load(held: bytes) -> Transducer:
        import zstandard

        labels, layers = pickle.loads(zstandard.decompress(held))
        return Transducer(labels, [tuple(x.astype(np.int64) for x in a) for a in layers])

    def walk(self) -> Rows:
        """All n-grams and their counts, shorter ones first."""
        depth = len(self.layers)
        grams, counts = [], []
        prefix, states = np.zeros((1, depth), np.int32), np.zeros(1, np.int64)
        for d, (start, label, count, target) in enumerate(self.layers):
            own, arcs = _arcs(start, states)
            prefix = prefix[own]
            prefix[:, d] = label[arcs]
            said = count[arcs] > 0
            grams.append(prefix[said])
            counts.append(count[arcs][said])
            on = target[arcs] >= 0
            prefix, states = prefix[on], target[arcs][on]
        return np.concatenate(grams), np.concatenate(counts)

    def entries(self) -> Rows:
        """All n-grams and their counts, in order."""
        return summed(*self.walk(), len(self.labels) + 1)

    def pieces(self, bounds: list[tuple[bytes, bytes]]) -> list[tuple[int, Transducer]]:
        """(range, transducer) of each range of prefixes that it reaches into; ``bounds`` are the first
        two words, sorted, at which ranges begin. States are shared within a piece as they were."""
        marks = [(0, 0), *bound_numbers(self.labels, bounds), (len(self.labels) + 1, 0)]
        made = [(k, self._between(lo, hi)) for k, (lo, hi) in enumerate(zip(marks, marks[1:], strict=False))]
        return [(k, piece) for k, piece in made if len(piece.layers[0][1])]

    def _between(self, lo: tuple[int, int], hi: tuple[int, int]) -> Transducer:
        _, label, count, target = self.layers[0]
        a, b = np.searchsorted(label, lo[0]), np.searchsorted(label, hi[0] + (hi[1] > 0))
        label, count, target = label[a:b], count[a:b].copy(), target[a:b]
        states, start = np.unique(target[target >= 0]), self.layers[1][0] if len(self.layers) > 1 else np.zeros(1, np.int64)
        root = np.where(target >= 0, np.searchsorted(states, target), -1) if len(states) else target
        held = [start[states], start[states + 1]] if len(states) else [np.zeros(0, np.int64)] * 2
        # The first words of the bounds keep a part of their second words: a state of its own.
        for word, second, side in ((lo[0], lo[1], 0), (hi[0], hi[1], 1)):
            at = np.flatnonzero(label == word)
            if second and len(at):
                k = root[at[0]]
                if side == 0:
                    count[at[0]] = 0
                if k >= 0:
                    first, last = int(held[0][k]), int(held[1][k])
                    cut = first + int(np.searchsorted(self.layers[1][1][first:last], second))
                    held[0], held[1] = np.append(held[0], cut if side == 0 else first), np.append(held[1], last if side == 0 else cut)
                    root[at[0]] = len(held[0]) - 1
        size = held[1] - held[0]
        root = np.where((root >= 0) & (size[root] > 0), root, -1) if len(size) else root
        kept = (count > 0) | (root >= 0)
        reached = np.unique(root[root >= 0])
        held, root = [x[reached] for x in held], np.where(root >= 0, np.searchsorted(reached, root), -1)
        layers = [(np.array([0, kept.sum()]), label[kept], count[kept], root[kept])]
        for d in range(1, len(self.layers)):
            size = held[1] - held[0]
            arcs = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(held[0], size)
            _, label, count, target = (x[arcs] if k else x for k, x in enumerate(self.layers[d]))
            states = np.unique(target[target >= 0])
            layers.append((np.concatenate([[0], np.cumsum(size)]), label, count, np.where(target >= 0, np.searchsorted(states, target), -1) if len(states) else target))
            held = [self.layers[d + 1][0][states + k] for k in (0, 1)] if len(states) else [np.zeros(0, np.int64)] * 2
        used = np.unique(np.concatenate([x[1] for x in layers]))
        return Transducer([self.labels[k - 1] for k in used.tolist()], [(s, np.searchsorted(used, x) + 1, c, t) for s, x, c, t in layers])

    def compose(self, other: Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """N-grams that both read, in this one's numbers, with both counts: the two are walked side
        by side, a layer at a time."""
        number = {w: k + 1 for k, w in enumerate(other.labels)}
        named = np.array([0, *(number.get(w, 0) for w in self.labels)], np.int64)
        grams, ours, theirs = [], [], []
        prefix, states, fellows = np.zeros((1, len(self.layers)), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for d in range(min(len(self.layers), len(other.layers))):
            start, label, count, target = self.layers[d]
            other_start, other_label, other_count, other_target = other.layers[d]
            own, arcs = _arcs(start, states)
            keys = np.repeat(np.arange(len(other_start) - 1), np.diff(other_start)) * (len(other.labels) + 1) + other_label
            wanted = fellows[own] * (len(other.labels) + 1) + named[label[arcs]]
            at = np.searchsorted(keys, wanted)
            met = (at < len(keys)) & (named[label[arcs]] > 0)
            met[met] = keys[at[met]] == wanted[met]
            own, arcs, at = own[met], arcs[met], at[met]
            prefix = prefix[own]
            prefix[:, d] = label[arcs]
            said = (count[arcs] > 0) & (other_count[at] > 0)
            grams.append(prefix[said])
            ours.append(count[arcs][said])
            theirs.append(other_count[at][said])
            on = (target[arcs] >= 0) & (other_target[at] >= 0)
            prefix, states, fellows = prefix[on], target[arcs][on], other_target[at][on]
        return np.concatenate(grams), np.concatenate(ours), np.concatenate(theirs)


def _arcs(start: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``states``, arc) of all arcs that leave ``states``."""
    size = start[states + 1] - start[states]
    own = np.repeat(np.arange(len(states)), size)
    return own, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[states][own]


class Builder:
    """Builds a transducer from sorted n-grams, block by block. A state is closed once the n-grams
    have gone on to another prefix; it then is looked up in the register of its layer, so that equal
    states exist once. A block holds whole first words; only the root stays open between blocks."""

    def __init__(self, labels: list[bytes], depth: int):
        self.labels, self.depth = labels, depth
        self.register: list[dict[bytes, int]] = [{} for _ in range(depth)]
        self.arcs: list[list[np.ndarray]] = [[] for _ in range(depth)]
        self.sizes: list[list[int]] = [[] for _ in range(depth)]

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        if not len(grams):
            return
        changed = np.ones(grams.shape, bool)
        changed[1:] = np.logical_or.accumulate(grams[1:] != grams[:-1], axis=1)
        prefix = np.cumsum(changed, axis=0) - 1  # of a row and depth: the number of its prefix
        below = np.zeros(0, np.int64)
        for d in range(self.depth - 1, -1, -1):
            rows = np.flatnonzero(changed[:, d] & (grams[:, d] > 0))
            last = grams[rows, d + 1] == 0 if d + 1 < self.depth else np.ones(len(rows), bool)
            target = below[prefix[rows, d]] if d + 1 < self.depth else np.full(len(rows), -1, np.int64)
            arcs = np.stack([grams[rows, d].astype(np.int64), np.where(last, counts[rows], 0), target], axis=1)
            if d == 0:
                self.arcs[0].append(arcs)
                continue
            owner = prefix[rows, d - 1]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            below = np.full(prefix[-1, d - 1] + 1, -1, np.int64)
            below[owner[first]] = self._states(d, arcs, first)

    def _states(self, d: int, arcs: np.ndarray, first: np.ndarray) -> list[int]:
        """The states of the runs of ``arcs`` that begin at ``first``; what the register lacks is new."""
        raw, register, width = arcs.tobytes(), self.register[d], arcs.itemsize * 3
        bounds = (np.append(first, len(arcs)) * width).tolist()
        runs = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        new = [r for r in dict.fromkeys(runs) if r not in register]
        register.update(zip(new, range(len(register), len(register) + len(new)), strict=True))
        self.arcs[d].append(np.frombuffer(b"".join(new), np.int64).reshape(-1, 3))
        self.sizes[d] += [len(r) // width for r in new]
        return list(map(register.__getitem__, runs))

    def finish(self) -> Transducer:
        layers = []
        for d in range(self.depth):
            arcs = np.concatenate(self.arcs[d]) if self.arcs[d] else np.zeros((0, 3), np.int64)
            sizes = [len(arcs)] if d == 0 else self.sizes[d]
            layers.append((np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), *arcs.T))
        return Transducer(self.labels, layers)


#: Rows of a block, or more if a first word has more.
ROWS = 1 << 17


def built(labels: list[bytes], grams: np.ndarray, counts: np.ndarray) -> Transducer:
    """The transducer of sorted distinct n-grams; labels that none of them has are left out."""
    used = np.unique(grams)
    used = used[used > 0]
    number = np.zeros(len(labels) + 1, np.int32)
    number[used] = np.arange(1, len(used) + 1)
    grams = number[grams]
    builder = Builder([labels[k - 1] for k in used.tolist()], grams.shape[1])
    firsts = np.flatnonzero(np.diff(grams[:, 0], prepend=-1)) if len(grams) else np.zeros(0, int)
    cuts = [0, *firsts[np.flatnonzero(np.diff(firsts // ROWS)) + 1].tolist(), len(grams)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        builder.add(grams[a:b], counts[a:b])
    return builder.finish()


def united(parts: list[Transducer]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(labels, n-grams, counts) of the union of ``parts``, counts of the same n-gram summed."""
    labels = sorted(set().union(*(p.labels for p in parts)))
    number = {w: k + 1 for k, w in enumerate(labels)}
    held = []
    for p in parts:
        grams, counts = p.walk()
        held.append((np.array([0, *(number[w] for w in p.labels)], np.int32)[grams], counts))
    return labels, *summed(np.concatenate([g for g, _ in held]), np.concatenate([c for _, c in held]), len(labels) + 1)


def bound_numbers(labels: list[bytes], bounds: list[tuple[bytes, bytes]]) -> list[tuple[int, int]]:
    """The least (first, second) word numbers that reach each of ``bounds``."""
    found = []
    for first, second in bounds:
        k = bisect_left(labels, first)
        known = k < len(labels) and labels[k] == first
        found.append((k + 1, bisect_left(labels, second) + 1 if known and second else 0))
    return found
