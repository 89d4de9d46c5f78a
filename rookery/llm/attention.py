"""A small causal self-attention model over classes of subword ids, trained and run in numpy.

The probability of an id is that of its class given the context, from one attention layer, times the id's share of its class in
the corpus. Classes have two levels: groups are clusters of ids with alike neighbours, and a group's members are its most frequent
ids, one by one, and all its others as the last member. So a position costs two short softmaxes, whatever the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Context window, new positions of each further window, width, hidden width, groups, and members of each group.
WINDOW, STRIDE, DIM, HIDDEN, GROUPS, MEMBERS = 32, 28, 16, 32, 32, 32
CLASSES = GROUPS * MEMBERS
_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Freed once, this raises the size from which glibc returns freed memory; else each step's arrays are mapped anew, page by page.
np.empty((1 << 25) - (1 << 16), np.uint8)


#: Ids whose neighbourhoods tell ids apart; all others count as one more.
LANDMARKS = 64


def landmarks(count: np.ndarray, end: int) -> np.ndarray:
    """The landmark of each id: its place among the most frequent ones, or LANDMARKS."""
    count = count.copy()
    count[end] = 0
    out = np.full(len(count), LANDMARKS)
    seen = np.argsort(-count, kind="stable")[: min(LANDMARKS, int((count > 0).sum()))]
    out[seen] = np.arange(len(seen))
    return out


def cluster(near: np.ndarray, end: int, seed: int = 3) -> np.ndarray:
    """Class (group times MEMBERS, and member) of every id, from how often each follows (side 0) and precedes (side 1) each landmark. Class 0 is the end, 1 holds the ids that the texts lack."""
    count = near[:, 0].sum(1)
    count[end] = 0
    seen = np.argsort(-count, kind="stable")[: int((count > 0).sum())]
    classes = np.ones(len(count), np.int32)
    classes[end] = 0
    if not len(seen):
        return classes
    near = near[seen]
    weight = np.sqrt(count[seen])
    near = np.sqrt((near + near.sum(0) / near.sum() * 2) / (near.sum(2, keepdims=True) + 2)).reshape(len(seen), -1)
    rng = np.random.default_rng(seed)
    centre = near[rng.choice(len(seen), min(GROUPS - 1, len(seen)), replace=False, p=weight / weight.sum())]
    for _ in range(25):
        label = (-2 * near @ centre.T + (centre**2).sum(1)).argmin(1)
        for j in range(len(centre)):
            if (label == j).any():
                centre[j] = np.average(near[label == j], axis=0, weights=weight[label == j])
    for j in range(len(centre)):
        group = seen[label == j]  # most frequent first
        classes[group] = (j + 1) * MEMBERS + np.minimum(np.arange(len(group)), MEMBERS - 1)
    return classes


def start(class_share: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "embed": normal(CLASSES, DIM, scale=0.5),
        "place": normal(WINDOW, DIM, scale=0.1),
        "qkv": normal(DIM, 3 * DIM, scale=DIM**-0.5),
        "mix": normal(DIM, DIM, scale=DIM**-0.5),
        "wide": normal(DIM, HIDDEN, scale=DIM**-0.5),
        "shift": np.zeros(HIDDEN, np.float32),
        "back": normal(HIDDEN, DIM, scale=HIDDEN**-0.5),
        "group": normal(DIM, GROUPS, scale=0.1),
        "group_base": np.log(class_share.reshape(GROUPS, MEMBERS).sum(1) + 1e-4).astype(np.float32),
        "member": normal(GROUPS, DIM, MEMBERS, scale=0.1),
        "member_base": np.log((class_share.reshape(GROUPS, MEMBERS) + 1e-7) / (class_share.reshape(GROUPS, MEMBERS).sum(1, keepdims=True) + MEMBERS * 1e-7)).astype(np.float32),
    }


def _row_totals(z: np.ndarray) -> np.ndarray:
    return z.reshape(-1, z.shape[-1]) @ np.ones(z.shape[-1], np.float32)


def _causal(q: np.ndarray, k: np.ndarray, most: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits of earlier positions, and their sums. Logits that overflow need a bound."""
    a = np.matmul(q, k.transpose(0, 2, 1))
    if most is not None:
        np.minimum(a, most, out=a)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(a, out=a)
        a *= _CAUSAL[-q.shape[1] :]
        return a, _row_totals(a).reshape(*a.shape[:2], 1)


def _scaled(w):
    """The weights of queries, keys and values side by side, with the queries' scale in them."""
    qkv = w["qkv"].copy()
    qkv[:, :DIM] *= np.float32(DIM**-0.5)
    return qkv


def _attend(w, x, qkv, first=0):
    """The layer's output for windows of classes from their position ``first`` on, and what the gradient needs."""
    e = w["embed"].take(x, axis=0)
    e += w["place"]
    all_three = (e.reshape(-1, DIM) @ qkv).reshape(*x.shape, 3 * DIM)
    q, k, v = all_three[:, first:, :DIM], all_three[:, :, DIM : 2 * DIM], all_three[:, :, 2 * DIM :]
    a, total = _causal(q, k)
    if not np.isfinite(total).all():
        a, total = _causal(q, k, 60.0)
    o = np.matmul(a, v)
    o /= total
    u = (o.reshape(-1, DIM) @ w["mix"]).reshape(o.shape)
    u += e[:, first:]
    m = u.reshape(-1, DIM) @ w["wide"]
    m += w["shift"]
    np.maximum(m, 0, out=m)
    h = (m @ w["back"]).reshape(u.shape)
    h += u
    return h, (e, q, k, v, a, total, o, u, m)


def _by_group(y: np.ndarray):
    """An order of positions by group, and each group with its range in it."""
    group = (y // MEMBERS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    stops = np.cumsum(np.bincount(group, minlength=GROUPS))
    return group, order, [(g, int(lo), int(hi)) for g, lo, hi in zip(range(GROUPS), stops - np.diff(stops, prepend=0), stops) if hi > lo]


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithms of the softmax of rows at one column each. Logits this small need no shift; if one overflows, the rows are shifted."""
    picked = z[np.arange(len(z)), at]
    with np.errstate(over="ignore"):
        total = np.exp(z) @ np.ones(z.shape[1], np.float32)
    if not np.isfinite(total).all():
        top = z.max(1)
        return picked - top - np.log(np.exp(z - top[:, None]).sum(1))
    return picked - np.log(total)


def log_probabilities(w, x: np.ndarray, y: np.ndarray, wanted: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Natural logarithms of the classes ``y`` at the ``wanted`` positions of windows ``x``, in order. Works in pieces whose arrays stay in the cache."""
    step, qkv = max(1, min(PIECE, rows // x.shape[1])), _scaled(w)
    h = np.concatenate([_attend(w, x[lo : lo + step], qkv)[0][wanted[lo : lo + step]] for lo in range(0, len(x), step)])
    y = y[wanted]
    group, order, ranges = _by_group(y)
    out = np.empty(len(y), np.float32)
    for lo in range(0, len(y), rows):
        z = h[lo : lo + rows] @ w["group"]
        z += w["group_base"]
        out[lo : lo + rows] = _log_softmax_at(z, group[lo : lo + rows])
    h, member, inner = h.take(order, axis=0), (y % MEMBERS)[order], np.empty(len(y), np.float32)
    for g, first, last in ranges:
        for lo in range(first, last, rows):
            hi = min(last, lo + rows)
            z = h[lo:hi] @ w["member"][g]
            z += w["member_base"][g]
            inner[lo:hi] = _log_softmax_at(z, member[lo:hi])
    out[order] += inner
    return out


def _less_target(z: np.ndarray, at: np.ndarray, n: np.float32) -> np.ndarray:
    """The gradient of the logits, in their own memory: their softmax less one at the target, divided by ``n``. Logits this small need no shift; if one overflows, the rows are shifted."""
    with np.errstate(over="ignore", invalid="ignore"):
        p = np.exp(z)
        total = p @ np.ones(z.shape[1], np.float32)
    if not np.isfinite(total).all():
        z -= z.max(1, keepdims=True)
        p = np.exp(z, out=z)
        total = p @ np.ones(z.shape[1], np.float32)
    p *= (1 / (n * total))[:, None]
    p[np.arange(len(p)), at] -= 1 / n
    return p


def _row_sums(p: np.ndarray) -> np.ndarray:
    return np.ones(len(p), np.float32) @ p


def _backward(w, qkv, dh: np.ndarray, kept, g: dict[str, np.ndarray]) -> np.ndarray:
    """The gradient of the layer's input from that of its output, which is overwritten; adds those of the layer's weights to ``g``."""
    e, q, k, v, a, total, o, u, m = kept
    a /= total
    dh2 = dh.reshape(-1, DIM)
    g["back"] += m.T @ dh2
    dm = dh2 @ w["back"].T
    dm *= m > 0
    g["wide"] += u.reshape(-1, DIM).T @ dm
    g["shift"] += _row_sums(dm)
    dh2 += dm @ w["wide"].T  # now the gradient of u
    g["mix"] += o.reshape(-1, DIM).T @ dh2
    do = (dh2 @ w["mix"].T).reshape(dh.shape)
    ds = np.matmul(do, v.transpose(0, 2, 1))
    o *= do
    ds -= _row_totals(o).reshape(*o.shape[:2], 1)  # a row's sum of a times its own gradient
    ds *= a
    first = e.shape[1] - q.shape[1]
    d = np.empty((*e.shape[:2], 3 * DIM), np.float32)
    d[:, :first, :DIM] = 0
    np.matmul(ds, k, out=d[:, first:, :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), do, out=d[:, :, 2 * DIM :])
    d = d.reshape(-1, 3 * DIM)
    g["qkv"] += e.reshape(-1, DIM).T @ d
    de = (d @ qkv.T).reshape(e.shape)
    de[:, first:] += dh
    g["place"] += de.sum(0)
    return de


#: Windows that go forward and backward together: more of them leave the cache, fewer cost calls.
PIECE = 128


def _pieces(x: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, int]]]:
    """An order of windows, and pieces of it with the first position wanted of any of their windows: all but a text's first window need their first positions as context only."""
    late = ~wanted[:, : WINDOW - STRIDE].any(1)
    order, n = np.argsort(late, kind="stable"), len(x) - int(late.sum())
    found = [(slice(lo, min(n, lo + PIECE)), 0) for lo in range(0, n, PIECE)]
    return order, found + [(slice(lo, lo + PIECE), WINDOW - STRIDE) for lo in range(n, len(x), PIECE)]


def gradients(w, x: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log probability at the wanted positions."""
    order, pieces = _pieces(x, wanted)
    x, y, wanted, qkv = x[order], y[order], wanted[order], _scaled(w)
    layers = [_attend(w, x[p], qkv, first) for p, first in pieces]
    h2 = np.concatenate([h.reshape(-1, DIM) for h, _ in layers])
    asked = np.concatenate([wanted[p, first:].ravel() for p, first in pieces])
    n, y = np.float32(max(1, int(asked.sum()))), y[wanted]
    group, order, ranges = _by_group(y)
    at = np.flatnonzero(asked)[order]  # positions by group from here on
    flat = np.ones((len(at), DIM + 1), np.float32)  # the last column meets the bases
    flat[:, :DIM] = h2.take(at, axis=0)
    outer = np.concatenate([w["group"], w["group_base"][None]])
    inner = np.concatenate([w["member"], w["member_base"][:, None]], axis=1)
    d_flat, d_inner = np.empty((len(at), DIM), np.float32), np.empty((len(at), DIM), np.float32)
    z, d_outer, by_member = np.empty((len(at), MEMBERS), np.float32), np.zeros_like(outer), np.zeros_like(inner)
    group, member, blocks = group[order], (y % MEMBERS)[order], [slice(lo, lo + 1024) for lo in range(0, len(at), 1024)]
    for b in blocks:
        p = _less_target(flat[b] @ outer, group[b], n)
        d_outer += flat[b].T @ p
        np.matmul(p, w["group"].T, out=d_flat[b])
    for j, lo, hi in ranges:
        np.matmul(flat[lo:hi], inner[j], out=z[lo:hi])
    for b in blocks:
        z[b] = _less_target(z[b], member[b], n)
    for j, lo, hi in ranges:
        by_member[j] = flat[lo:hi].T @ z[lo:hi]
        np.matmul(z[lo:hi], w["member"][j].T, out=d_inner[lo:hi])
    d_flat += d_inner
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["group"], g["group_base"], g["member"], g["member_base"] = d_outer[:DIM], d_outer[DIM], by_member[:, :DIM], by_member[:, DIM]
    dh2 = np.zeros_like(h2)
    dh2[at] = d_flat
    dx, lo = [], 0
    for h, kept in layers:
        hi = lo + h.shape[0] * h.shape[1]
        dx.append(_backward(w, qkv, dh2[lo:hi].reshape(h.shape), kept, g).reshape(-1, DIM))
        lo = hi
    g["qkv"][:, :DIM] *= np.float32(DIM**-0.5)
    # rows of one class lie side by side and are summed as runs
    inputs = x.ravel().astype(np.uint16)
    order = np.argsort(inputs, kind="stable")
    inputs = inputs[order]
    starts = np.flatnonzero(np.diff(inputs, prepend=np.uint16(CLASSES)))
    g["embed"][inputs[starts]] = np.add.reduceat(np.concatenate(dx).take(order, axis=0), starts, axis=0)
    return g


def train(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, wanted: np.ndarray, epochs: int, rate: float, seed: int = 1, batch: int = 64) -> dict[str, np.ndarray]:
    """Adam over windows in random order."""
    w = {k: v.copy() for k, v in w.items()}
    rng, step = np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    steps = max(1, epochs * ((len(x) + batch - 1) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            rows = order[lo : lo + batch]
            step += 1
            now = rate * (1 - 0.9 * step / steps)
            for k, g in gradients(w, x[rows], y[rows], wanted[rows]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] -= np.float32(now) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + np.float32(1e-7))
    return w


def windows(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts: inputs, targets, the positions each scores, and the text of each window.

    ``classes`` has the texts' classes in a row, each text followed by the end class 0, which also stands before a
    text as its first input; ``counts`` has their lengths with it. Every position is wanted by exactly one window.
    """
    number = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(counts)), number)
    index = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    place = np.arange(WINDOW, dtype=np.int32)
    left = (counts[text] - index * STRIDE).astype(np.int32)
    wanted = place < left[:, None]
    wanted &= (index == 0)[:, None] | (place >= WINDOW - STRIDE)
    # one row holds a window's inputs and targets; zeros stand before the first text and after the last
    padded = np.concatenate([np.zeros(1, classes.dtype), classes, np.zeros(WINDOW, classes.dtype)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[(np.cumsum(counts) - counts)[text] + index * STRIDE]
    x, y = rows[:, :-1], rows[:, 1:]
    x[index == 0, 0] = 0
    return x, y, wanted, text


@dataclass(frozen=True)
class Model:
    """Weights, the class of each id, and the log of each id's share of its class."""

    weights: dict[str, np.ndarray]
    classes: np.ndarray
    share: np.ndarray

    def score(self, flat: np.ndarray, counts: np.ndarray, block: int = 1024) -> np.ndarray:
        """log10 probability of each text; ``flat`` has the texts' ids, each followed by the end id."""
        x, y, wanted, text = windows(self.classes[flat], counts)
        total = np.zeros(len(counts))
        for lo in range(0, len(x), block):
            part = slice(lo, lo + block)
            got = log_probabilities(self.weights, x[part], y[part], wanted[part])
            total += np.bincount(np.repeat(text[part], wanted[part].sum(1)), got, len(counts))
        stops = np.cumsum(counts)
        shares = np.concatenate([[0.0], np.cumsum(self.share[flat], dtype=np.float64)])
        return (total + shares[stops] - shares[stops - counts]) / np.log(10)
