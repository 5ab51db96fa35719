"""A one-layer causal self-attention model over subword ids, in numpy."""

from __future__ import annotations

WIDTH, CONTEXT, STRIDE = 24, 16, 12
#: The output has two levels, GROUPS times MEMBERS classes: the most frequent ids have a class
#: each, all others share BINS classes of about equal mass. Classes are also the input rows.
GROUPS, MEMBERS, BINS = 32, 32, 32
#: Windows that go through attention at once: few enough for their arrays to stay in a cache.
CACHED = 128
CLASSES = GROUPS * MEMBERS
_SHAPES = {
    "embed": (CLASSES, WIDTH), "place": (CONTEXT, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "o": (WIDTH, WIDTH),
    "top": (WIDTH, GROUPS), "top_bias": (GROUPS,), "leaf": (GROUPS, WIDTH, MEMBERS), "leaf_bias": (GROUPS, MEMBERS),
}


def vocabulary(counts):
    """Of each id, by its training count: the class, and the natural logarithm of its probability
    in its class (add-half smoothed, so each class sums to one)."""
    import numpy as np

    n = len(counts)
    order = np.argsort(-counts, kind="stable")
    mass = counts[order] + 0.5
    alone = min(CLASSES - BINS, max(n - BINS, 0))
    kind = np.arange(n)
    tail = np.cumsum(mass[alone:])
    if n > alone:
        kind[alone:] = alone + np.minimum((tail - mass[alone:] / 2) / tail[-1] * BINS, BINS - 1).astype(int)
    classes, inside = np.empty(n, np.int32), np.empty(n, np.float32)
    classes[order] = kind
    inside[order] = np.log(mass / np.bincount(kind, mass, CLASSES)[kind])
    return classes, inside


def start(class_counts, seed: int = 11) -> dict:
    """Weights before training: small random ones, and biases that give the classes' shares."""
    import numpy as np

    rng = np.random.default_rng(seed)
    model = {n: (rng.standard_normal(s) * 0.1).astype(np.float32) for n, s in _SHAPES.items()}
    mass = (class_counts + 0.5).reshape(GROUPS, MEMBERS)
    top = mass.sum(axis=1)
    return model | {"top_bias": np.log(top / top.sum()).astype(np.float32), "leaf_bias": np.log(mass / top[:, None]).astype(np.float32)}


def pack(model: dict) -> bytes:
    return b"".join(model[n].tobytes() for n in _SHAPES)


def unpack(data: bytes) -> dict:
    import numpy as np

    return _views(np.frombuffer(data, np.float32).copy())


def _views(flat) -> dict:
    """The parts of a model that lies in one array."""
    import numpy as np

    at, model = 0, {}
    for n, shape in _SHAPES.items():
        size = int(np.prod(shape))
        model[n], at = flat[at : at + size].reshape(shape), at + size
    return model


#: A row of a table: a state and a zero, a query, a key, a value and a one. Weighed sums of values then
#: hold the weights' sum, and what is divided by that has a one behind it, by which biases are added.
STATE, QUERY, KEY, VALUE = slice(WIDTH + 1), slice(WIDTH + 1, 2 * WIDTH + 1), slice(2 * WIDTH + 1, 3 * WIDTH + 1), slice(3 * WIDTH + 1, 4 * WIDTH + 2)
#: Arrays that are filled anew at each step, in memory that has been touched before.
_ROOM: dict = {}


def _room(name: str, shape: tuple, kind):
    import math

    import numpy as np

    size = math.prod(shape)
    if (name, kind) not in _ROOM or _ROOM[name, kind].size < size:
        _ROOM[name, kind] = np.empty(size, kind)
    return _ROOM[name, kind][:size].reshape(shape)


def _tables(m: dict):
    """The projections of a state, (WIDTH, 3 * WIDTH), the rows of the classes and of the places, and the
    most that a weight's logarithm may be: of what a place may not see, none. Queries are scaled and values have gone through ``o`` already. As all is linear, a window's rows are
    sums of these, and no product over its rows is left."""
    import numpy as np

    qkv = m["qkv"]
    mix = np.concatenate([qkv[:, :WIDTH] * np.float32(WIDTH**-0.5), qkv[:, WIDTH : 2 * WIDTH], qkv[:, 2 * WIDTH :] @ m["o"]], axis=1)
    rows = []
    for n, one in (("embed", 1), ("place", 0)):
        ends = np.broadcast_to(np.array([0, one], mix.dtype), (len(m[n]), 2))
        rows.append(np.concatenate([m[n], ends[:, :1], m[n] @ mix, ends[:, 1:]], axis=1))
    return mix, *rows, np.where(np.tri(CONTEXT, dtype=bool), 60, -np.inf).astype(mix.dtype)


def _forward(tables, x, rows, a, z, skip: int = 0):
    """Fills in, for windows of classes, their rows, their weights before division and the states
    after attention (each with a one behind it), from the place ``skip`` on; returns the weights' sums."""
    import numpy as np

    _, kinds, places, most = tables
    t = x.shape[1]
    kinds.take(x, axis=0, out=rows, mode="clip")
    rows += places[:t]
    np.matmul(rows[:, skip:, QUERY], rows[..., KEY].transpose(0, 2, 1), out=a)
    np.minimum(a, most[skip:t, :t], out=a)
    np.exp(a, out=a)
    np.matmul(a, rows[..., VALUE], out=z)
    sums = z[..., WIDTH:].copy()
    z /= sums
    z += rows[:, skip:, STATE]
    return sums


def _attend(m: dict, x):
    """Of each window its rows, its attention and the states after it."""
    import numpy as np

    tables = _tables(m)
    kind, t = tables[0].dtype, x.shape[1]
    rows, a, z = (np.empty((*x.shape, n), kind) for n in (4 * WIDTH + 2, t, WIDTH + 1))
    a /= _forward(tables, x, rows, a, z)
    return rows, a, z[..., :WIDTH]


def _sorted(kinds, n: int):
    """An order of small numbers, and the edges of each of the ``n`` in it."""
    import numpy as np

    order = np.argsort(kinds.astype(np.uint8 if n <= 256 else np.uint16), kind="stable")  # a radix sort
    return order, np.concatenate([[0], np.cumsum(np.bincount(kinds, minlength=n))])


def _leaves(m: dict):
    """For each group, the weights of all groups beside those of its own members, biases as a last row."""
    import numpy as np

    top = np.concatenate([m["top"], m["top_bias"][None]])
    leaf = np.concatenate([m["leaf"], m["leaf_bias"][:, None]], axis=1)
    return np.concatenate([np.broadcast_to(top, (GROUPS, *top.shape)), leaf], axis=2)


def _spans(edges):
    return [(g, a, b) for g, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]


def _exponents(leaves, z, spans):
    """exp of the logits of the groups and of the members of each row's own group, for rows (with a
    one behind each for the bias) sorted by group, and their sums, (n, 2). Logits are clipped far beyond
    what a trained model gives, so that nothing overflows."""
    import numpy as np

    p = _room("p", (len(z), GROUPS + MEMBERS), z.dtype)
    for g, a, b in spans:
        np.matmul(z[a:b], leaves[g], out=p[a:b])
    np.clip(p, -60, 60, out=p)
    np.exp(p, out=p)
    return p, (p.reshape(-1, MEMBERS) @ np.ones(MEMBERS, p.dtype)).reshape(-1, 2)


def log_probability(m: dict, z, classes):
    """Natural log probability of a class after each state (n, WIDTH): its group's by all groups,
    then its own by the members of that group."""
    import numpy as np

    return _log_probability(_leaves(m), np.concatenate([z, np.ones((len(z), 1), z.dtype)], axis=1), np.arange(len(z)), classes)


def _log_probability(leaves, z, at, classes):
    """The same for the rows ``at`` of states with a one behind each. Rows are sorted by group once."""
    import numpy as np

    order, edges = _sorted(classes // MEMBERS, GROUPS)
    y = classes[order]
    zs = z.take(at[order], axis=0, out=_room("zs", (len(y), WIDTH + 1), z.dtype), mode="clip")
    p, sums = _exponents(leaves, zs, _spans(edges))
    flat, first, found = p.reshape(-1), np.arange(0, p.size, GROUPS + MEMBERS), np.empty(len(y), z.dtype)
    # Not the logarithm of a quotient, which can be too small for single precision.
    found[order] = np.log(flat.take(first + y // MEMBERS)) + np.log(flat.take(first + (GROUPS + y % MEMBERS))) - np.log(sums).sum(axis=1)
    return found


def gradient(m: dict, windows, classes) -> dict:
    """Of the mean negative log likelihood of the windows' ids, each from those before it. Some windows
    at a time go forth and back through attention, so that their arrays stay in a cache."""
    import numpy as np

    x, wanted = classes[np.maximum(windows[:, :-1], 0)], windows[:, 1:].ravel()
    real = np.flatnonzero(wanted >= 0)
    y = classes[wanted[real]]
    order, edges = _sorted(y // MEMBERS, GROUPS)
    y, at, share = y[order], real[order], np.float32(1 / max(1, len(y)))
    (w, t), n = x.shape, len(y)
    tables, leaves = _tables(m), _leaves(m)
    mix, kind = tables[0], tables[0].dtype
    rows, a, z = (_room(k, (w, t, s), kind) for k, s in (("rows", 4 * WIDTH + 2), ("a", t), ("z", WIDTH + 1)))
    for lo in range(0, w, CACHED):
        part = slice(lo, lo + CACHED)
        a[part] /= _forward(tables, x[part], rows[part], a[part], z[part])
    zs = z.reshape(-1, WIDTH + 1).take(at, axis=0, out=_room("zs", (n, WIDTH + 1), kind), mode="clip")
    outer, dzs, back = np.zeros(leaves.shape, kind), _room("dzs", (n + 1, WIDTH), kind), np.ascontiguousarray(leaves[:, :WIDTH].transpose(0, 2, 1))
    spans = _spans(edges)
    p, sums = _exponents(leaves, zs, spans)
    pairs = p.reshape(-1, 2, MEMBERS)
    pairs *= (share / sums)[:, :, None]
    flat, first = p.reshape(-1), np.arange(0, p.size, GROUPS + MEMBERS)
    flat[first + y // MEMBERS] -= share
    flat[first + (GROUPS + y % MEMBERS)] -= share
    for g, lo, hi in spans:
        np.matmul(zs[lo:hi].T, p[lo:hi], out=outer[g])
        np.matmul(p[lo:hi], back[g], out=dzs[lo:hi])
    dzs[n] = 0  # of what follows a text's end
    spot = np.full(x.size, n)
    spot[at] = np.arange(n)
    d = dzs.take(spot, axis=0, out=_room("d", (x.size, WIDTH), kind), mode="clip").reshape(w, t, WIDTH)
    dmix = np.zeros(mix.shape, kind)
    for lo in range(0, w, CACHED):
        part = slice(lo, lo + CACHED)
        dz, b, row = d[part], a[part], rows[part]
        da = np.matmul(dz, row[..., 3 * WIDTH + 1 : 4 * WIDTH + 1].transpose(0, 2, 1), out=_room("da", b.shape, kind))
        da -= np.einsum("bts,bts->bt", da, b)[:, :, None]
        da *= b
        dm = _room("dm", (*dz.shape[:2], 3 * WIDTH), kind)
        np.matmul(da, row[..., KEY], out=dm[..., :WIDTH])
        np.matmul(da.transpose(0, 2, 1), row[..., QUERY], out=dm[..., WIDTH : 2 * WIDTH])
        np.matmul(b.transpose(0, 2, 1), dz, out=dm[..., 2 * WIDTH :])
        dm = dm.reshape(-1, 3 * WIDTH)
        dmix += row.reshape(-1, row.shape[2])[:, :WIDTH].T @ dm
        dz += np.matmul(dm, mix.T, out=_room("dx", (len(dm), WIDTH), kind)).reshape(dz.shape)
    order, edges = _sorted(x.ravel(), CLASSES)
    there = np.flatnonzero(np.diff(edges))
    g, dv = {n: np.zeros(s, np.float32) for n, s in _SHAPES.items()}, dmix[:, 2 * WIDTH :]
    g["embed"][there] = np.add.reduceat(d.reshape(-1, WIDTH).take(order, axis=0, out=_room("sorted", (x.size, WIDTH), kind), mode="clip"), edges[there], axis=0)
    g["place"][:t] = (np.ones(w, kind) @ d.reshape(w, -1)).reshape(t, WIDTH)
    g["qkv"][:] = np.concatenate([dmix[:, :WIDTH] * np.float32(WIDTH**-0.5), dmix[:, WIDTH : 2 * WIDTH], dv @ m["o"].T], axis=1)
    g["o"][:] = m["qkv"][:, 2 * WIDTH :].T @ dv
    top, leaf = outer[:, :, :GROUPS].sum(axis=0), outer[:, :, GROUPS:]
    g["top"][:], g["top_bias"][:], g["leaf"][:], g["leaf_bias"][:] = top[:WIDTH], top[WIDTH], leaf[:, :WIDTH], leaf[:, WIDTH]
    return g


def train(m: dict, windows, classes, steps: int, rate: float, seed: int, batch: int = 256) -> dict:
    """``steps`` of Adam over ``windows``: (n, CONTEXT + 1) ids, -1 where a text has ended."""
    import numpy as np

    if not len(windows):
        return m
    rng, flat = np.random.default_rng(seed), np.frombuffer(pack(m), np.float32).copy()
    first, second, move = (np.zeros_like(flat) for _ in range(3))
    order, at = rng.permutation(len(windows)), 0
    m = _views(flat)  # a change of the flat array is one of the model
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(windows)), 0
        g = gradient(m, windows[order[at : at + batch]], classes)
        g = np.concatenate([g[n].ravel() for n in _SHAPES])
        at += batch
        # In place: the moments of Adam, then rate * first / (root of second + 1e-8), both without their bias.
        np.multiply(g, g, out=move)
        move -= second
        move *= np.float32(0.01)
        second += move
        g -= first
        g *= np.float32(0.1)
        first += g
        np.multiply(second, np.float32(1 / (1 - 0.99**step)), out=move)
        np.sqrt(move, out=move)
        move += np.float32(1e-8)
        np.divide(first, move, out=move)
        move *= np.float32(rate / (1 - 0.9**step))
        flat -= move
    return m


def score(m: dict, texts: list, classes, inside, end: int, block: int = 1024):
    """Natural log probability of each text, an array of ids, and of its end.

    Windows of CONTEXT ids start STRIDE apart and overlap; a window scores what the one before
    has not, so each id and the end are scored once, all but the first few after at least
    CONTEXT - STRIDE ids. Windows of many texts go through in one batch; what a window holds beyond
    its text's end comes after every real id, where the causal mask keeps it out of sight.
    """
    import numpy as np

    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.full(begin[-1] + CONTEXT, end, np.int64)
    for t, b in zip(texts, begin, strict=False):
        ids[b + 1 : b + 1 + len(t)] = t  # the end of the text before stands for its beginning
    kinds, each = classes[ids], inside[ids].astype(np.float64)
    per = 1 + np.maximum(0, -(-(sizes - CONTEXT) // STRIDE))
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    low, high = np.repeat(begin[:-1], per) + nth * STRIDE, np.repeat(begin[1:], per)
    seen, tables, leaves = np.lib.stride_tricks.sliding_window_view(kinds, CONTEXT), _tables(m), _leaves(m)
    kind = leaves.dtype
    # A text's first window scores all its ids; of the others the first few only are attended to.
    for skip, chosen in ((0, np.flatnonzero(nth == 0)), (CONTEXT - STRIDE, np.flatnonzero(nth))):
        t = CONTEXT - skip
        for lo in range(0, len(chosen), block):
            some = chosen[lo : lo + block]
            z = _room("z", (len(some), t, WIDTH + 1), kind)
            for at in range(0, len(some), CACHED):
                x = seen[low[some[at : at + CACHED]]]
                rows, a = _room("rows", (*x.shape, 4 * WIDTH + 2), kind), _room("a", (len(x), t, CONTEXT), kind)
                _forward(tables, x, rows, a, z[at : at + CACHED], skip)
            spot = low[some][:, None] + np.arange(skip, CONTEXT)
            real = np.flatnonzero(spot < high[some][:, None])
            # The id after a text's last is the end: it stands there as the next text's beginning.
            target = spot.ravel()[real] + 1
            each[target] += _log_probability(leaves, z.reshape(-1, WIDTH + 1), real, kinds[target])
    # Of each text the places after its first, and the one after its last.
    return np.add.reduceat(each[1 : begin[-1] + 1], begin[:-1]) if len(texts) else np.zeros(0)
