"""A small causal self-attention language model in numpy.

Positions come in blocks; a block's queries see its own positions up to themselves and the whole block before it in the same
document, so windows of two blocks overlap by one and every position is scored once. The output layer has two levels:
a softmax over classes of ids, then one over the ids of the class; ids outside the table share a class of their own, in
which their corpus counts decide. All probabilities of an id sequence therefore sum to one. The logits start at the smoothed
corpus bigrams of the ids (:class:`Prior`); attention learns what the wider context adds to them.
"""

from __future__ import annotations

import numpy as np

BLOCK, WIDTH, KEY, HIDDEN, MEMBERS = 16, 24, 8, 48, 32


class Vocabulary:
    """compact: from a tokenizer's id to a number below ``size``, or ``size`` for the others; log10 of the others' shares."""

    def __init__(self, counts: np.ndarray, end_count: int, size: int = 32 * MEMBERS, members: int = MEMBERS):
        self.size, self.members, self.end, self.begin = size, members, size - 1, size + 1  # the last slot is the end of a text
        order = np.argsort(-counts, kind="stable")[: size - 1]
        self.compact = np.full(len(counts), size, np.int32)
        self.compact[order] = np.arange(len(order))
        rest = np.where(self.compact == size, counts, 0).astype(np.float64) + 1.0
        rest[order] = 0
        self.log_other = np.log10(np.maximum(rest, 1e-300) / max(rest.sum(), 1e-300)).astype(np.float32)
        frequency = np.append(np.zeros(size, np.float64), max(rest.sum() - (rest > 0).sum(), 0))
        frequency[: len(order)] = counts[order]
        frequency[self.end] = end_count
        self.frequency = frequency + 0.5


def table_shape(counts: np.ndarray, enough: int = 100) -> tuple[int, int]:
    """Size of the table and members of a class, near its root: room for every id seen ``enough`` times, and for 1,023 at least."""
    ids = int((counts >= enough).sum()) + 1
    members = MEMBERS
    while members * members < ids:
        members += MEMBERS
    return max(-(-ids // members), MEMBERS) * members if members == MEMBERS else -(-ids // members) * members, members


def blocks_of(sequences: list[np.ndarray], vocabulary: Vocabulary):
    """inputs and targets (blocks x BLOCK), places that count, blocks that begin a text, text of each block."""
    sizes = np.array([len(s) + 1 for s in sequences], np.int64)
    many = -(-sizes // BLOCK)
    total = int(many.sum())
    starts = (np.cumsum(many) - many) * BLOCK
    inputs = np.full(total * BLOCK, vocabulary.begin, np.int32)
    targets = np.zeros(total * BLOCK, np.int32)
    flat = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.int32)
    lengths = sizes - 1
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))
    targets[at] = flat
    targets[starts + lengths] = vocabulary.end
    inputs[at + 1 - ((at + 1) >= len(inputs))] = flat  # a text's last id has its end to predict from it
    valid = np.zeros(total * BLOCK, bool)
    valid[at] = valid[starts + lengths] = True
    first = np.zeros(total, bool)
    first[starts // BLOCK] = True
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), valid.reshape(-1, BLOCK), first, np.repeat(np.arange(len(sizes)), many), at


_offset = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]  # how far a key lies back
_CAUSAL = np.where(_offset >= 0, 0, -1e9).astype(np.float32)
_BACK = np.clip(_offset, 0, 2 * BLOCK - 1)
_FIRST = np.r_[np.full(BLOCK, -1e9), np.zeros(BLOCK)].astype(np.float32)
#: Blocks worked on at once: few enough for attention to stay in a core's cache, more for the output layer.
NARROW, WIDE = 64, 1024


def joint_counts(before: np.ndarray, ids: np.ndarray, n: np.ndarray, size: int):
    """Pair counts across words, drawn towards the case that words are independent: the counts that stay, and the spread for :class:`Prior`.

    How far is what predicts each pair best from all the others.
    """
    total, shares = np.bincount(before, weights=n, minlength=size + 2), np.bincount(ids, weights=n, minlength=size + 1)
    shares = shares / max(shares.sum(), 1)
    left_out = lambda k: (n * np.log((n - 1 + k * shares[ids]) / (total[before] - 1 + k))).sum()
    k = max(10.0 ** np.arange(1, 7), key=left_out)
    return n * (total / (total + k))[before], (k * total / (total + k), shares)


class Prior:
    """Log probabilities of classes, and of members within their class, given the id before.

    Members have a row for each id and class seen after it, and one for each class after all other ids: ``place`` has the row of each.
    """

    def __init__(self, vocabulary: Vocabulary, pairs, spread=None, pull: float = 20.0):
        """pairs: counts by (id before, id), both compact, or arrays of ids before, ids and counts; rows: the table, the others, the begin of a text.

        spread: further counts of each id before, dealt over the ids by given shares.
        """
        if isinstance(pairs, np.ndarray):
            pairs = (*(at := np.nonzero(pairs)), pairs[at])
        before, ids, n = pairs
        members, classes = vocabulary.members, vocabulary.size // vocabulary.members
        pulled = pull * vocabulary.frequency / vocabulary.frequency.sum()
        more, shares = spread or (np.zeros(vocabulary.size + 2), np.zeros(vocabulary.size + 1))
        inside, dealt, group = pulled[:-1].reshape(classes, members), shares[:-1].reshape(classes, members), ids // members
        by_class = np.append(inside.sum(1), pulled[-1]) + more[:, None] * np.append(dealt.sum(1), shares[-1])
        np.add.at(by_class, (before, group), n)
        by_class /= by_class.sum(1, keepdims=True)
        self.classes = np.log(by_class).astype(np.float32)
        known = group < classes
        keys, where = np.unique(before[known] * classes + group[known], return_inverse=True)
        self.row_class = np.concatenate([keys % classes, np.arange(classes)])
        usual = more @ more / max(more.sum(), 1e-9)
        rows = inside[self.row_class] + np.append(more[keys // classes], np.full(classes, usual))[:, None] * dealt[self.row_class]
        np.add.at(rows, (where, ids[known] % members), n[known])
        self.members = np.log(rows / rows.sum(1, keepdims=True)).astype(np.float32)
        self.place = np.tile(np.arange(len(keys), len(rows), dtype=np.int32), vocabulary.size + 2)
        self.place[keys] = np.arange(len(keys))


def fresh(vocabulary: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    members, classes = vocabulary.members, vocabulary.size // vocabulary.members
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "embedding": normal(vocabulary.size + 2, WIDTH, scale=0.5), "query": normal(WIDTH, KEY, scale=0.3), "key": normal(WIDTH, KEY, scale=0.3),
        "value": normal(WIDTH, WIDTH, scale=0.2), "back": np.zeros(2 * BLOCK, np.float32),
        "mix": normal(2 * WIDTH, HIDDEN, scale=0.2), "mix_bias": np.zeros(HIDDEN, np.float32),
        "classes": normal(HIDDEN, classes + 1, scale=0.02), "class_bias": np.zeros(classes + 1, np.float32),
        "members": normal(classes, HIDDEN, members, scale=0.02), "member_bias": np.zeros((classes, members), np.float32),
    }


def _shift(x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), 2 * BLOCK, x.shape[2]), x.dtype)
    out[:, BLOCK:], out[1:, :BLOCK], out[:1, :BLOCK] = x, x[:-1], 0
    return out


def _projection(p: dict) -> np.ndarray:
    """Query, key and value side by side, for one product."""
    return np.concatenate([p["query"] * np.float32(KEY**-0.5), p["key"], p["value"]], axis=1)


def _forward(p: dict, inputs: np.ndarray, first: np.ndarray):
    x = p["embedding"][inputs]
    made = (x.reshape(-1, WIDTH) @ _projection(p)).reshape(*inputs.shape, -1)
    q, kv = made[..., :KEY], _shift(made[..., KEY:])
    k2, v2 = kv[..., :KEY], kv[..., KEY:]
    s = np.matmul(q, k2.transpose(0, 2, 1))
    s += p["back"][_BACK] + _CAUSAL
    s[first] += _FIRST
    np.minimum(s, 30, out=s)
    np.exp(s, out=s)
    s /= np.matmul(s, np.ones((2 * BLOCK, 1), np.float32))
    z = np.empty((*inputs.shape, 2 * WIDTH), np.float32)
    z[..., :WIDTH] = x
    np.matmul(s, v2, out=z[..., WIDTH:])
    z = z.reshape(-1, 2 * WIDTH)
    h = z @ p["mix"]
    h += p["mix_bias"]
    np.maximum(h, 0, out=h)
    return x, q, k2, v2, s, z, h


class Scorer:
    """A trained model arranged for scoring: what depends on an id alone is looked up."""

    def __init__(self, p: dict, prior: Prior):
        e = p["embedding"]
        self.query, self.key = e @ (p["query"] * np.float32(KEY**-0.5)), e @ p["key"]
        self.value = np.concatenate([e @ p["value"], np.ones((len(e), 1), np.float32)], axis=1)
        self.mixed, self.mix = e @ p["mix"][:WIDTH] + p["mix_bias"], p["mix"][WIDTH:]
        self.back = np.exp(p["back"][_BACK] + _CAUSAL)
        self.classes, self.members = p["classes"], p["members"]
        self.class_bias = prior.classes + p["class_bias"]
        self.member_bias, self.place = prior.members + p["member_bias"][prior.row_class], prior.place

    def hidden(self, inputs: np.ndarray, first: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """before: the block before the first one, for a chunk that does not begin with a text."""
        ids = inputs if before is None else np.concatenate([before[None], inputs])
        k, v = self.key[ids], self.value[ids]
        if before is None:
            k, v = np.concatenate([k[:1], k]), np.concatenate([v[:1], v])
        k2, v2 = np.concatenate([k[:-1], k[1:]], axis=1), np.concatenate([v[:-1], v[1:]], axis=1)
        v2[first, :BLOCK] = 0
        s = np.matmul(self.query[inputs], k2.transpose(0, 2, 1))
        np.minimum(s, 30, out=s)
        np.exp(s, out=s)
        s *= self.back
        a = np.matmul(s, v2).reshape(-1, WIDTH + 1)
        h = (a[:, :WIDTH] / a[:, WIDTH:]) @ self.mix
        h += self.mixed[inputs.reshape(-1)]
        return np.maximum(h, 0, out=h)

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural logs of the targets' probabilities by place (of the class alone for ids outside the table)."""
        out = np.empty(targets.shape, np.float32)
        for i in range(0, len(inputs), WIDE):
            parts = [self.hidden(inputs[j : j + NARROW], first[j : j + NARROW], inputs[j - 1] if j else None) for j in range(i, min(i + WIDE, len(inputs)), NARROW)]
            out[i : i + WIDE] = self._output(np.concatenate(parts), inputs[i : i + WIDE].reshape(-1), targets[i : i + WIDE].reshape(-1)).reshape(-1, BLOCK)
        return out

    def _output(self, h: np.ndarray, before: np.ndarray, t: np.ndarray) -> np.ndarray:
        members = self.members.shape[2]
        group = t // members
        a = h @ self.classes
        a += self.class_bias[before]
        chosen = a[np.arange(len(t)), group]
        np.exp(a, out=a)
        total = a @ np.ones(a.shape[1], np.float32)
        order = np.argsort(group.astype(np.int16), kind="stable")
        ends = np.searchsorted(group[order], np.arange(len(self.members) + 1))
        h, known = h[order], order[: ends[-1]]
        b = np.empty((len(known), members), np.float32)
        for c in range(len(self.members)):
            np.matmul(h[ends[c] : ends[c + 1]], self.members[c], out=b[ends[c] : ends[c + 1]])
        b += self.member_bias[self.place[before[known] * len(self.members) + group[known]]]
        own = b[np.arange(len(known)), t[known] % members]
        np.exp(b, out=b)
        total[known] *= b @ np.ones(members, np.float32)
        chosen[known] += own
        return chosen - np.log(total)


def _softmax(x: np.ndarray) -> None:
    """Of each row, in place."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x /= x @ np.ones((x.shape[1], 1), np.float32)


def gradients(p: dict, prior: Prior, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log probability of the valid places."""
    x, q, k2, v2, s, z, h = _forward(p, inputs, first)
    t, w = targets.reshape(-1), (valid.reshape(-1) / max(1, valid.sum())).astype(np.float32)
    members = p["members"].shape[2]
    group = t // members
    g: dict[str, np.ndarray] = {}
    before = inputs.reshape(-1)
    a = prior.classes[before]
    a += p["class_bias"]
    a += h @ p["classes"]
    _softmax(a)
    a[np.arange(len(t)), group] -= 1
    a *= w[:, None]
    g["classes"], g["class_bias"] = h.T @ a, np.ones(len(a), np.float32) @ a
    dh = a @ p["classes"].T
    # Places by class, so that only the products go class by class and all else is done at once; ids outside the table come last.
    # A column of ones takes the bias along.
    order = np.argsort(group.astype(np.int16), kind="stable")
    ends = np.searchsorted(group[order], np.arange(len(p["members"]) + 1)).tolist()
    known = order[: ends[-1]]
    own, of = np.ones((len(known), HIDDEN + 1), np.float32), group[known]
    np.take(h, known, axis=0, out=(back := np.empty((len(known), HIDDEN), np.float32)), mode="clip")
    own[:, :HIDDEN] = back
    weights = np.concatenate([p["members"], p["member_bias"][:, None]], axis=1)
    dw = np.zeros_like(weights)
    b = np.empty((len(known), members), np.float32)
    ranges = [(c, slice(i, j)) for c, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i]
    for c, rows in ranges:
        np.matmul(own[rows], weights[c], out=b[rows])
    b += prior.members[prior.place[before[known] * len(p["members"]) + of]]
    _softmax(b)
    b[np.arange(len(known)), t[known] - of * members] -= 1
    b *= w[known, None]
    for c, rows in ranges:
        part = b[rows]
        np.matmul(own[rows].T, part, out=dw[c])
        np.matmul(part, p["members"][c].T, out=back[rows])
    g["members"], g["member_bias"] = dw[:, :HIDDEN], dw[:, HIDDEN]
    dh[known] += back
    dh *= h > 0
    g["mix"], g["mix_bias"] = z.T @ dh, dh.sum(0)
    dz = (dh @ p["mix"].T).reshape(*inputs.shape, 2 * WIDTH)
    dx, da = dz[..., :WIDTH].copy(), dz[..., WIDTH:]
    ds = np.matmul(da, v2.transpose(0, 2, 1))
    dv2 = np.matmul(s.transpose(0, 2, 1), da)
    ds *= s
    ds -= s * np.matmul(ds, np.ones((2 * BLOCK, 1), np.float32))
    g["back"] = np.bincount(_BACK.ravel(), weights=ds.sum(0).ravel(), minlength=2 * BLOCK).astype(np.float32)
    d = np.empty((*inputs.shape, 2 * KEY + WIDTH), np.float32)
    np.matmul(ds, k2, out=d[..., :KEY])
    for back, part in ((np.matmul(ds.transpose(0, 2, 1), q), slice(KEY, 2 * KEY)), (dv2, slice(2 * KEY, None))):
        np.add(back[:-1, BLOCK:], back[1:, :BLOCK], out=d[:-1, :, part])
        d[-1, :, part] = back[-1, BLOCK:]
    d = d.reshape(-1, 2 * KEY + WIDTH)
    made = x.reshape(-1, WIDTH).T @ d
    g["query"], g["key"], g["value"] = made[:, :KEY] * np.float32(KEY**-0.5), made[:, KEY : 2 * KEY], made[:, 2 * KEY :]
    dx += (d @ _projection(p).T).reshape(dx.shape)
    ids = inputs.reshape(-1)
    order = np.argsort(ids, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
    g["embedding"] = np.zeros_like(p["embedding"])
    g["embedding"][ids[order][begin]] = np.add.reduceat(dx.reshape(-1, WIDTH)[order], begin, axis=0)
    return g


def held_back(p: dict, prior: Prior, sequences: list[np.ndarray], vocabulary: Vocabulary) -> float:
    """Mean log probability of sequences that were not trained on."""
    inputs, targets, valid, first, _, _ = blocks_of(sequences, vocabulary)
    return float((Scorer(p, prior).log_probabilities(inputs, targets, first) * valid).sum(dtype=np.float64) / valid.sum())


def train(p: dict, prior: Prior, sequences: list[np.ndarray], vocabulary: Vocabulary, epochs: int, rate: float, batch: int = 96, seed: int = 5, back: int = 0) -> dict:
    """Adam over batches of consecutive blocks in random order, with a falling rate.

    With ``back``, so many sequences at the end are held back, and the parameters after the epoch that suits them best are kept.
    """
    if len(sequences) <= back:
        return p
    sequences, kept = sequences[: len(sequences) - back], sequences[len(sequences) - back :]
    best, most = p, held_back(p, prior, kept, vocabulary) if back else 0.0
    rng = np.random.default_rng(seed)
    inputs, targets, valid, first, _, _ = blocks_of(sequences, vocabulary)
    flat = packed(p)
    p = unpacked(flat, p)  # views: a step changes all at once
    m, v, t = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    starts = np.arange(0, len(inputs), batch)
    steps, n = epochs * len(starts), 0
    for _ in range(epochs):
        for i in rng.permutation(starts):
            n += 1
            begin = first[i : i + batch].copy()
            begin[0] = True
            g = packed(gradients(p, prior, inputs[i : i + batch], targets[i : i + batch], valid[i : i + batch], begin))
            step = np.float32(rate * min(1.0, n / 20) * (1 - n / (steps + 1)) * np.sqrt(1 - 0.999**n) / (1 - 0.9**n))
            np.subtract(g, m, out=t)
            t *= np.float32(0.1)
            m += t
            g *= g
            g -= v
            g *= np.float32(0.001)
            v += g
            np.sqrt(v, out=t)
            t += np.float32(1e-7)
            np.divide(m, t, out=t)
            t *= step
            flat -= t
        if back and (now := held_back(p, prior, kept, vocabulary)) > most:
            best, most = {k: x.copy() for k, x in p.items()}, now
    return best if back else p


def packed(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpacked(vector: np.ndarray, like: dict) -> dict:
    """Views of the vector."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out
