"""A causal self-attention model over subword ids, in numpy.

Each position of a text is a subword id with a vector of its own; what is predicted is
one of CLASSES classes, where a word begins: first its group, then which of the group's
members it is. A text is scored in windows of CONTEXT + BLOCK positions that overlap by
CONTEXT; only words that begin in the last BLOCK positions of a window are predicted, so
every word is scored once and sees at least CONTEXT positions before it (texts begin
behind that many start marks). For training a text is cut into windows of the same width
that do not overlap, and every word that begins in a window is predicted.
"""

from __future__ import annotations

import numpy as np

#: Classes that are predicted: GROUPS groups of MEMBERS.
GROUPS, MEMBERS = 16, 64
CLASSES = GROUPS * MEMBERS
#: Subword ids that have a vector; the id after the last is the start mark.
IDS, START = 65_535, 65_535
CONTEXT = BLOCK = 40
WIDTH, DIM = CONTEXT + BLOCK, 16
#: Windows in one training step, and kept for training at once; batches whose windows are
#: sorted by their numbers of words, so that little is filled up.
BATCH, HELD, SORTED = 128, 1 << 15, 8
#: Windows whose attention is worked out at once, and words whose classes are: what they need
#: stays in a core's cache.
SMALL, ROWS = 32, 1 << 12
#: A task's first EARLY windows go in batches of LITTLE.
EARLY, LITTLE = 4096, 16
RATE, DECAY = 0.01, 0.01

#: Exponents up to this size need no shift.
SAFE = 60

_BEFORE = np.tri(WIDTH, dtype=np.float32)
_ONES = np.ones(max(WIDTH, MEMBERS, GROUPS), np.float32)
SHAPES = {"e": (IDS + 1, DIM), "p": (WIDTH, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM), "g": (DIM, GROUPS), "gb": (GROUPS,), "u": (GROUPS, DIM, MEMBERS), "b": (GROUPS, MEMBERS)}


def initial(prior: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; before training the model predicts the prior."""
    rng = np.random.default_rng(seed)
    model = {k: (rng.normal(0, 0.3 if k in "ep" else DIM**-0.5, s)).astype(np.float32) for k, s in SHAPES.items()}
    prior = np.maximum(prior.reshape(GROUPS, MEMBERS), 1e-30)
    for k in "gu":
        model[k] *= np.float32(0.05)
    model["gb"] = np.log(prior.sum(axis=1)).astype(np.float32)
    model["b"] = np.log(prior / prior.sum(axis=1, keepdims=True)).astype(np.float32)
    return model


def packed(model: dict[str, np.ndarray]) -> bytes:
    return b"".join(model[k].astype(np.float32).tobytes() for k in SHAPES)


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    flat, at, model = np.frombuffer(raw, np.float32), 0, {}
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        model[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return model


def _laid(tokens: np.ndarray, classes, starts, lead: int, width: int):
    """(inputs, targets, mask) of one text behind `lead` start marks, filled up to whole
    widths: at each input what comes next. starts: whether a word begins at an id, classes:
    the words' classes, one for each start; without them every id is a word and its own class."""
    n = len(tokens)
    size = -(-(lead + n) // width) * width
    inputs = np.full(size, START, np.uint16)
    inputs[lead + 1 : lead + n] = tokens[:-1]
    mask = np.zeros(size, bool)
    mask[lead : lead + n] = True if starts is None else starts
    target = np.zeros(size, np.uint16)
    target[mask] = tokens if classes is None else classes
    return inputs, target, mask


def streams(tokens: np.ndarray, classes: np.ndarray | None = None, starts: np.ndarray | None = None, most: int = 1 << 30):
    """(inputs, targets, mask) of one text for scoring: CONTEXT start marks, then its blocks.
    A text of over `most` positions gives several, each behind the CONTEXT positions before it."""
    inputs, target, mask = _laid(tokens, classes, starts, CONTEXT, BLOCK)
    size = max(1, most // BLOCK) * BLOCK
    for at in range(CONTEXT, len(inputs), size):
        part = slice(at - CONTEXT, at + size)
        own = mask[part].copy()
        own[:CONTEXT] = False
        yield inputs[part], target[part], own


def windows(tokens: np.ndarray, classes: np.ndarray | None = None, starts: np.ndarray | None = None, shift: int = 0):
    """(inputs, targets, mask) of one text for training, each (n, WIDTH): windows that do not
    overlap, the first of which has `shift` more start marks, so that words stand at any place."""
    return tuple(x.reshape(-1, WIDTH) for x in _laid(tokens, classes, starts, shift, WIDTH))


def _asked(mask: np.ndarray):
    """Of a mask (n, places): row and place of each word, its number within the row, and
    the places as a matrix, filled up with 0."""
    row, place = np.nonzero(mask)
    count = np.bincount(row, minlength=len(mask))
    rank = np.arange(len(row)) - np.repeat(count.cumsum() - count, count)
    every = np.zeros((len(mask), int(count.max())), np.int64)
    every[row, rank] = place
    return row, place, rank, every


def _mild(z: np.ndarray) -> bool:
    """Whether exponents of all of z, and their sums, can do without a shift."""
    return not z.size or bool(z.max() <= SAFE and z.min() >= -SAFE)


def _exponents(score: np.ndarray, before: np.ndarray) -> np.ndarray:
    """exp of the scores of what lies before, else 0; in place. Large ones are shifted."""
    if not _mild(score):
        score -= np.where(before > 0, score, -np.inf).max(axis=2, keepdims=True)
        np.minimum(score, 0, out=score)
    np.exp(score, out=score)
    score *= before
    return score


def _fit(z: np.ndarray, y: np.ndarray, n: int = 0) -> np.ndarray:
    """Log of the softmax of z at y; for n > 0 leaves in z the gradient of minus their sum over n."""
    if not _mild(z):
        z -= z.max(axis=1, keepdims=True)
    at = np.arange(len(z))
    fit = z[at, y]
    np.exp(z, out=z)
    total = z @ _ONES[: z.shape[1]].astype(z.dtype)
    if n:
        z *= (1 / (total * z.dtype.type(n)))[:, None]
        z[at, y] -= z.dtype.type(1 / n)
    return fit - np.log(total)


def _by_group(group: np.ndarray):
    """(order, [(group, start, end)]): words sorted by group, and each group's run."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    ends = np.bincount(group, minlength=GROUPS).cumsum()
    return order, [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())) if a < b]


class Scorer:
    """Log10 probabilities of the words of streams; per-id and per-place products are made once."""

    def __init__(self, model: dict[str, np.ndarray]):
        s, out = np.float32(DIM**-0.5), model["v"] @ model["o"]
        asks = lambda x: np.concatenate([x, x @ model["q"] * s], axis=1)
        tells = lambda x: np.concatenate([x @ model["k"], x @ out], axis=1)
        e, p = model["e"], model["p"]
        self.ask, self.ask_place, self.tell, self.tell_place = asks(e), asks(p), tells(e), tells(p)
        self.g, self.gb, self.u, self.b = (model[k] for k in ("g", "gb", "u", "b"))

    def __call__(self, inputs: np.ndarray, target: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """For streams one after another; one number for each place of the mask, in order."""
        own = mask[CONTEXT:].reshape(-1, BLOCK)
        count = own.sum(axis=1)
        first, y = count.cumsum() - count, target[CONTEXT:][mask[CONTEXT:]]
        h = np.empty((len(y), DIM), np.float32)
        view = np.lib.stride_tricks.sliding_window_view(inputs, WIDTH)[::BLOCK]
        by_count = np.argsort(count, kind="stable")
        by_count = by_count[count[by_count] > 0]
        for i in range(0, len(by_count), SMALL):
            at = by_count[i : i + SMALL]
            w = view[at]
            row, place, rank, every = _asked(own[at])
            every += CONTEXT
            x = self.ask.take(w[np.arange(len(at))[:, None], every], axis=0)
            x += self.ask_place[every]
            kv = self.tell.take(w, axis=0)
            kv += self.tell_place
            score = x[:, :, DIM:] @ np.ascontiguousarray(kv[:, :, :DIM].transpose(0, 2, 1))
            score = _exponents(score, _BEFORE.take(every, axis=0))
            seen = score @ kv[:, :, DIM:]
            seen /= (score @ _ONES[:WIDTH])[:, :, None]
            seen += x[:, :, :DIM]
            h[first[at[row]] + rank] = seen[row, rank]
        group, member = np.divmod(y.astype(np.int64), MEMBERS)
        got = np.empty(len(y))
        for i in range(0, len(y), ROWS):
            z = h[i : i + ROWS] @ self.g
            z += self.gb
            got[i : i + ROWS] = _fit(z, group[i : i + ROWS])
        order, runs = _by_group(group)
        for g, a, b in runs:
            for c in range(a, b, ROWS):
                at = order[c : min(b, c + ROWS)]
                z = h.take(at, axis=0) @ self.u[g]
                z += self.b[g]
                got[at] += _fit(z, member[at])
        return got / np.log(10)


def gradients(m: dict[str, np.ndarray], ids: np.ndarray, target: np.ndarray, mask: np.ndarray):
    """(mean loss in nats, its gradients) over the words of windows. The gradient of the
    ids' vectors is (ids seen, their rows)."""
    n, s = max(1, int(mask.sum())), m["q"].dtype.type(DIM**-0.5)
    wq, wkv_t = m["q"] * s, np.concatenate([m["k"].T, m["v"].T])
    kept, late_own, o_own = [], [], []
    for i in range(0, len(ids), SMALL):
        row, place, rank, every = _asked(mask[i : i + SMALL])
        x = m["e"].take(ids[i : i + SMALL], axis=0)
        x += m["p"]
        kv_t = wkv_t @ x.transpose(0, 2, 1)
        kv = kv_t.transpose(0, 2, 1)
        late = x[np.arange(len(x))[:, None], every]
        q = (late.reshape(-1, DIM) @ wq).reshape(late.shape)
        # a: weights that are not yet shares; what they add up to divides the smaller o and do
        a = q @ kv_t[:, :DIM]
        a = _exponents(a, _BEFORE.take(every, axis=0).astype(x.dtype, copy=False))
        total = (a @ _ONES[:WIDTH].astype(x.dtype))[:, :, None]
        o = a @ kv[:, :, DIM:]
        o /= total
        late_own.append(late[row, rank])
        o_own.append(o[row, rank])
        kept.append((row, place, rank, x, kv, kv_t, q, a, total, o))
    late, own_o = np.concatenate(late_own), np.concatenate(o_own)
    h = late + own_o @ m["o"]
    group, member = np.divmod(target[mask].astype(np.int64), MEMBERS)
    z = h @ m["g"]
    z += m["gb"]
    loss = _fit(z, group, n).sum()
    g = {"g": h.T @ z, "gb": z.sum(axis=0), "u": np.zeros_like(m["u"]), "b": np.zeros_like(m["b"])}
    dh = z @ m["g"].T
    order, runs = _by_group(group)
    by_group, member = h[order], member[order]
    z, back = np.empty((len(h), MEMBERS), h.dtype), np.empty_like(by_group)
    for j, first, last in runs:
        part = z[first:last]
        np.matmul(by_group[first:last], m["u"][j], out=part)
        part += m["b"][j]
    loss += _fit(z, member, n).sum()
    for j, first, last in runs:
        part = z[first:last]
        g["u"][j], g["b"][j] = by_group[first:last].T @ part, part.sum(axis=0)
        np.matmul(part, m["u"][j].T, out=back[first:last])
    dh[order] += back
    g["o"] = own_o.T @ dh
    do_own, own_dq, dx_all = dh @ m["o"].T, np.empty_like(dh), np.empty((*ids.shape, DIM), h.dtype)
    dwkv_t, at = np.zeros_like(wkv_t), 0
    for i, (row, place, rank, x, kv, kv_t, q, a, total, o) in zip(range(0, len(ids), SMALL), kept):
        own = slice(at, at + len(row))
        at += len(row)
        do = np.zeros_like(o)
        do[row, rank] = do_own[own]
        do /= total
        da = do @ kv_t[:, DIM:]
        da -= np.einsum("ijk,ijk->ij", do, o)[:, :, None]
        da *= a
        own_dq[own] = (da @ kv[:, :, :DIM])[row, rank]
        d_t = np.empty_like(kv_t)
        np.matmul(q.transpose(0, 2, 1), da, out=d_t[:, :DIM])
        np.matmul(do.transpose(0, 2, 1), a, out=d_t[:, DIM:])
        dwkv_t += (d_t @ x).sum(axis=0)
        dx = dx_all[i : i + SMALL]
        np.matmul(d_t.transpose(0, 2, 1), wkv_t, out=dx)
        dx[row, place] += dh[own] + own_dq[own] @ wq.T
    g["q"], g["k"], g["v"] = late.T @ own_dq * s, dwkv_t[:DIM].T, dwkv_t[DIM:].T
    g["p"], dx = dx_all.sum(axis=0), dx_all.reshape(-1, DIM)
    by_id = np.argsort(ids, axis=None, kind="stable")
    each = ids.ravel()[by_id]
    first = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
    g["e"] = each[first], np.add.reduceat(dx[by_id], first)
    return float(-loss / n), g


class Trainer:
    """Adam steps over windows of texts, which are handed over one after another; each
    window is seen once."""

    def __init__(self, model: dict[str, np.ndarray], seed: int, rate: float = RATE):
        self.model, self.rng, self.rate = model, np.random.default_rng(seed), rate
        self.m = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        self.v = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        self.steps, self.seen, self.parts, self.n = 0, 0, [], 0

    def add(self, tokens: np.ndarray, classes: np.ndarray | None = None, starts: np.ndarray | None = None) -> None:
        part = windows(tokens, classes, starts, int(self.rng.integers(WIDTH)))
        own = part[2].any(axis=1)
        self.parts.append(tuple(x[own] for x in part))
        self.n += int(own.sum())
        if self.n >= HELD:
            self.train()

    def train(self) -> None:
        """Steps over the windows kept so far, in random order."""
        if not self.n:
            return
        ids, target, mask = (np.concatenate(x) for x in zip(*self.parts))
        n, self.parts, self.n, i = self.n, [], 0, 0
        order, count = self.rng.permutation(n), mask.sum(axis=1)
        while i < n:
            size = LITTLE if self.seen < EARLY else BATCH
            some = order[i : i + SORTED * size]
            some = some[np.argsort(count[some], kind="stable")]
            for j in self.rng.permutation(-(-len(some) // size)):
                at = some[j * size : (j + 1) * size]
                self.step(ids[at], target[at], mask[at])
            self.seen, i = self.seen + len(some), i + len(some)

    def step(self, ids, target, mask) -> float:
        loss, g = gradients(self.model, ids, target, mask)
        self.steps += 1
        rate = self.rate * min(1.0, self.steps / 20)
        one, two = np.float32(1 - 0.9**self.steps), np.float32(1 - 0.99**self.steps)
        for k in SHAPES:
            # of the ids' vectors only those seen in this step move
            at, x = g[k] if k == "e" else (slice(None), g[k])
            m = self.m[k][at] * np.float32(0.9) + x * np.float32(0.1)
            v = self.v[k][at] * np.float32(0.99) + x * x * np.float32(0.01)
            self.m[k][at], self.v[k][at] = m, v
            change = (m / one) / (np.sqrt(v / two) + np.float32(1e-6))
            self.model[k][at] = self.model[k][at] * np.float32(1 if k in ("b", "gb", "e") else 1 - rate * DECAY) - np.float32(rate) * change
        return loss
