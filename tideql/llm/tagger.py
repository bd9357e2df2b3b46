"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside; 1 + 2 k begins and 2 + 2 k continues a span of kind k.
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 20
#: Windows overlap by half: any span of up to OVERLAP characters lies whole in one.
WIDTH, OVERLAP = 96, 48
#: An address that ends so close to its window's end counts as cut by it.
CUT = 2
#: Training texts and steps, their batch, windows decoded at once, and the seed of it all.
TEXTS, STEPS, BATCH, CHUNK, SEED = 4000, 420, 48, 512, 11

_SYMBOLS = "abcdefghijklmnopqrstuvwxyz @.-_+()[]{}:/,;#*%&|<>=\n\"'"
PAD, DIGIT, UPPER, LETTER, OTHER = range(len(_SYMBOLS), len(_SYMBOLS) + 5)
CLASSES = OTHER + 1
_CLASS = np.full(128, OTHER, np.uint8)
for _i, _c in enumerate(_SYMBOLS):
    _CLASS[ord(_c)] = _i
_CLASS[48:58] = DIGIT
_CLASS[65:91] = UPPER


def encoded(text: str) -> np.ndarray:
    """Character classes of a text, one for each code point."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _CLASS[np.minimum(code, 127)], LETTER).astype(np.uint8)


def allowed() -> np.ndarray:
    """(TAGS + 1, TAGS): 0 where a tag may follow another, else a large negative number; the
    last row is the start of a window, where a span may be under way."""
    free = np.zeros((TAGS + 1, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        for before in range(TAGS):
            if before not in (inside, inside - 1):
                free[before, inside] = -1e4
    return free


class Tagger:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {f"{n}{d}": rng.normal(0, s, shape).astype(np.float32) for d in "fb" for n, s, shape in (("x", 0.3, (CLASSES, 4 * h)), ("h", h**-0.5, (h, 4 * h)))}
        for d in "fb":
            self.w[f"x{d}"][:, h : 2 * h] += 1  # gates that keep start open
        self.w |= {"o": rng.normal(0, 0.2, (2 * h, TAGS)).astype(np.float32), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS + 1, TAGS), np.float32)}
        self.free = allowed().astype(np.float32)

    def _run(self, ids: np.ndarray, d: str, keep: bool):
        """Hidden states (T, B, H) of one direction, in the order of the text; and what its gradient needs."""
        order = range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1)
        n, h = len(ids), HIDDEN
        out, c, s = np.zeros((ids.shape[1], n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        kept, wx, wh = {}, self.w[f"x{d}"], self.w[f"h{d}"]
        for t in order:
            z = wx[ids[:, t]] + s @ wh
            gate = 1 / (1 + np.exp(-z[:, : 3 * h]))
            g = np.tanh(z[:, 3 * h :])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            before, past = c, s
            c = f * c + i * g
            tc = np.tanh(c)
            s = o * tc
            out[t] = s
            if keep:
                kept[t] = (i, f, o, g, before, past, tc)
        return out, (list(order), kept)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(T, B, TAGS)."""
        both = np.concatenate([self._run(ids, d, False)[0] for d in "fb"], axis=2)
        return both @ self.w["o"] + self.w["c"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tags (B, T) of windows of classes."""
        got = []
        for at in range(0, len(ids), CHUNK):
            e = self.emissions(ids[at : at + CHUNK])
            move = self.w["t"] + self.free
            best, back = e[0] + move[TAGS], []
            for t in range(1, len(e)):
                step = best[:, :, None] + move[None, :TAGS]
                back.append(step.argmax(axis=1))
                best = step.max(axis=1) + e[t]
            tag = best.argmax(axis=1)
            path = [tag]
            for b in reversed(back):
                tag = b[np.arange(len(tag)), tag]
                path.append(tag)
            got.append(np.stack(path[::-1], axis=1))
        return np.concatenate(got) if got else np.zeros((0, WIDTH), int)

    def gradients(self, ids: np.ndarray, tags: np.ndarray):
        """(mean negative log-likelihood, its gradients) of windows with their tags."""
        n, length, h = len(ids), ids.shape[1], HIDDEN
        runs = {d: self._run(ids, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        e = (both @ self.w["o"] + self.w["c"]).astype(np.float64)
        move = (self.w["t"] + self.free).astype(np.float64)

        def total(x, axis):
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = [e[0] + move[TAGS]], [np.zeros((n, TAGS))]
        for t in range(1, length):
            alpha.append(total(alpha[-1][:, :, None] + move[None, :TAGS], 1) + e[t])
        for t in range(length - 1, 0, -1):
            beta.append(total(move[None, :TAGS] + (e[t] + beta[-1])[:, None, :], 2))
        beta = beta[::-1]
        z = total(alpha[-1], 1)
        rows, g = np.arange(n), {k: np.zeros_like(v) for k, v in self.w.items()}
        path = e[0][rows, tags[:, 0]] + move[TAGS, tags[:, 0]]
        de = np.empty_like(e)
        dt = np.zeros((TAGS + 1, TAGS))
        for t in range(length):
            de[t] = np.exp(alpha[t] + beta[t] - z[:, None])
            if t:
                path += e[t][rows, tags[:, t]] + move[tags[:, t - 1], tags[:, t]]
                pair = np.exp(alpha[t - 1][:, :, None] + move[None, :TAGS] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
                dt[:TAGS] += pair.sum(axis=0)
                np.subtract.at(dt, (tags[:, t - 1], tags[:, t]), 1)
            else:
                dt[TAGS] += de[0].sum(axis=0)
                np.subtract.at(dt, (np.full(n, TAGS), tags[:, 0]), 1)
        for t in range(length):
            de[t][rows, tags[:, t]] -= 1
        de, g["t"] = (de / n).astype(np.float32), (dt / n).astype(np.float32)
        g["o"], g["c"] = np.tensordot(both, de, ([0, 1], [0, 1])), de.sum(axis=(0, 1))
        dboth = de @ self.w["o"].T
        for at, d in enumerate("fb"):
            order, kept = runs[d][1]
            ds, dc, dz_all = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((length, n, 4 * h), np.float32)
            wh = self.w[f"h{d}"]
            for t in reversed(order):
                i, f, o, gg, before, past, tc = kept[t]
                ds = ds + dboth[t][:, at * h : (at + 1) * h]
                dc = dc + ds * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                g[f"h{d}"] += past.T @ dz
                dz_all[t] = dz
                ds, dc = dz @ wh.T, dc * f
            hot = np.zeros((length * n, CLASSES), np.float32)
            hot[np.arange(length * n), ids.T.ravel()] = 1
            g[f"x{d}"] = hot.T @ dz_all.reshape(-1, 4 * h)
        return float((z - path).mean()), g


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of one window's tags."""
    found, open_ = [], None
    for t, tag in enumerate([*tags.tolist(), 0]):
        if open_ is not None and not (tag and tag % 2 == 0 and (tag - 2) // 2 == open_[0]):
            found.append((*open_, t))
            open_ = None
        if tag and open_ is None:
            open_ = ((tag - 1) // 2, t)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


_ENDINGS = ("com", "org", "net", "edu", "io", "de", "fr", "es", "co.uk")


def _word(rng: random.Random, most: int = 9) -> str:
    return "".join(rng.choice(("th", "re", "an", "ou", "ti", "le", "ch", "o", "e", "st", "in", "a", "n", "é", "ung", "s")) for _ in range(rng.randrange(1, most // 2 + 1)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up text and the (kind, start, end) of the personal data written into it, in
    plain and in disguised forms, among numbers and addresses that are none."""

    def email():
        name = rng.choice([_word, lambda r: f"{_word(r)}.{_word(r)}", lambda r: f"{_word(r)}_{r.randrange(99)}", lambda r: f"{_word(r)}{r.randrange(999)}"])(rng).replace("é", "e")
        host, end = _word(rng).replace("é", "e"), rng.choice(_ENDINGS)
        at, dot = rng.choice([("@", ".")] * 4 + [(" @ ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" [at] ", "."), (" AT ", " DOT ")])
        return name + at + host + dot + end.replace(".", dot)

    def ip():
        sep = rng.choice(["."] * 5 + [" . ", "[.]", " dot "])
        return sep.join(str(rng.randrange(256)) for _ in range(4))

    def card():
        d = rng.choice("3456") + _digits(rng, rng.choice([13, 14, 14, 14, 14, 15, 18 - 1]) - 1 + 1)
        d += next(x for x in "0123456789" if luhn(d + x))
        sep = rng.choice(["", "", " ", "-", ".", "  ", " - ", "_"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone():
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return rng.choice(
            [f"+{rng.randrange(1, 99)} ({a}) {b}-{c}", f"+{rng.randrange(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.randrange(11, 99)} {a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"+{rng.randrange(1, 99)}{a}{b}{c}", f"0{_digits(rng, 2)}/{b}{c}"]
        )

    def none():
        return rng.choice(
            [str(rng.randrange(10 ** rng.randrange(1, 9))), f"{rng.randrange(1, 999)},{_digits(rng, 3)}.{_digits(rng, 2)}", f"20{_digits(rng, 2)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", f"{rng.randrange(24)}:{_digits(rng, 2)}", f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(12, 40))), f"@{_word(rng)}", f"{_word(rng)} dot {_word(rng)}", f"{_word(rng)} at {_word(rng)}", f"password={_digits(rng, 6)}{_word(rng)}", _digits(rng, rng.randrange(8, 22)), f"{rng.randrange(99)}%", f"{rng.randrange(1900, 2030)}", f"{_word(rng)}@", f"({rng.randrange(99)})", f"{rng.randrange(12)}/{rng.randrange(30)}/20{_digits(rng, 2)}"]
        )

    text, spans = "", []
    while len(text) < WIDTH + 40:
        text += "".join(_word(rng) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rng.randrange(1, 6)))
        roll = rng.random()
        if roll < 0.7:
            k = rng.randrange(4)
            got = (email, ip, card, phone)[k]()
            spans.append((k, len(text), len(text) + len(got)))
            text += got
        else:
            text += none()
        text += rng.choice([" ", " ", ". ", ", ", "\n", ") ", "; "])
    return text, spans


@functools.lru_cache(1)
def trained(seed: int = SEED) -> Tagger:
    """A tagger learnt from TEXTS made-up texts and their spans; the same on every run."""
    rng, tagger = random.Random(seed), Tagger(seed)
    ids, tags = np.full((TEXTS, WIDTH), PAD, np.uint8), np.zeros((TEXTS, WIDTH), np.int64)
    for row in range(TEXTS):
        text, spans = example(rng)
        whole = np.zeros(len(text), np.int64)
        for k, a, b in spans:
            whole[a] = 1 + 2 * k
            whole[a + 1 : b] = 2 + 2 * k
        at = rng.randrange(len(text) - WIDTH // 2)
        part = encoded(text)[at : at + WIDTH]
        ids[row, : len(part)] = part
        tags[row, : len(part)] = whole[at : at + WIDTH]
    m, v = ({k: np.zeros_like(x) for k, x in tagger.w.items()} for _ in "mv")
    picks = np.random.default_rng(seed)
    for step in range(1, STEPS + 1):
        at = picks.integers(0, TEXTS, BATCH)
        _, g = tagger.gradients(ids[at], tags[at])
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / STEPS)
        for k, w in tagger.w.items():
            x = g[k] * np.float32(min(1, 5 / max(size, 1e-9)))
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
            w -= np.float32(rate) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + np.float32(1e-6))
    return tagger


#: Every span that can be settled holds a digit, an at sign, or an "at" in brackets or spaces
#: that a word and a dot, plain or spelled out, come after. Windows without any need no look.
TRIGGER = re.compile(r"[0-9@]|(?<=[ (\[])at(?=[ )\]])(?= ?[)\]]? ?[0-9a-z-]+ ?[(\[]?(?:\.|(?<=[ (\[])dot(?=[ )\]])))", re.IGNORECASE)


def as_marked(kind: int, text: str, a: int, b: int):
    return kind, a, b


def found(tagger: Tagger, text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in a whole text, as marked. Windows that overlap by half are decoded,
    then reconciled over the text: of spans that overlap, that which lies farther from the
    edges of its window stays, then the longer, then the earlier."""
    return found_in(tagger, [text])[0]


def found_in(tagger: Tagger, texts: list[str], settle=as_marked, every: bool = False, together: int = 4 * CHUNK) -> list[list[tuple[int, int, int]]]:
    """found() of many texts: their windows are decoded together, a bounded number at once.
    Each marked span is settled before spans are reconciled; None drops it. An address that its
    window's end cuts goes on as the next window marks it. Windows without a TRIGGER, other
    than those next to one with an address's, are left out, unless every one is wanted."""
    marks: list[list] = [[] for _ in texts]
    owner, start, parts = [], [], []

    def flush():
        tags = tagger.decode(np.stack(parts))
        for row, i, first in zip(tags, owner, start):
            n = len(texts[i])
            for k, a, b in spans_of(row) if row.any() else ():
                left, right = (a if first else WIDTH), (WIDTH - b if first + WIDTH < n else WIDTH)
                if b + first <= n:
                    marks[i].append((k, first + a, first + b, min(left, right, OVERLAP // 2), first))
        owner.clear(), start.clear(), parts.clear()

    for i, text in enumerate(texts):
        n = max(1, -(-len(text) // OVERLAP))
        if every:
            places = range(n)
        else:
            near = {(m.start() // OVERLAP, m[0].isdigit()) for m in TRIGGER.finditer(text)}
            places = sorted({w for x, digit in near for w in range(x - 1, x + 1 if digit else x + 2) if 0 <= w < n})
        if not places:
            continue
        ids = encoded(text)
        for w in places:
            part = np.full(WIDTH, PAD, np.uint8)
            piece = ids[w * OVERLAP : w * OVERLAP + WIDTH]
            part[: len(piece)] = piece
            owner.append(i), start.append(w * OVERLAP), parts.append(part)
            if len(parts) >= together:
                flush()
    if parts:
        flush()
    offers: list[list] = [[] for _ in texts]
    for i, mine in enumerate(marks):
        for at, (k, a, b, margin, _) in enumerate(mine):
            span = settle(k, texts[i], a, b)
            if span and k == 0 and (end := joined(mine, at)) > b:
                span = settle(k, texts[i], a, end)
            if span:
                offers[i].append((-margin, span[1] - span[2], span[1], span[0], span[2]))
    return [reconciled(x) for x in offers]


def joined(marks: list[tuple[int, int, int, int, int]], at: int) -> int:
    """Where an address ends that its window's end cuts: where the next window's mark of an
    address does that holds the cut. marks: (kind, start, end, margin, window's start)."""
    _, _, b, _, first = marks[at]
    if first + WIDTH - b <= CUT:
        for k, a2, b2, _, other in marks[at + 1 :]:
            if other > first + OVERLAP:
                break
            if k == 0 and other > first and a2 < b < b2:
                return b2
    return b


def reconciled(offers: list) -> list[tuple[int, int, int]]:
    """Spans that do not overlap, the best offers first; offers: (-margin, -length, start, kind, end)."""
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for _, _, a, k, b in sorted(set(offers)):
        at = bisect.bisect_left(starts, a)
        if (at == 0 or taken[at - 1][2] <= a) and (at == len(starts) or starts[at] >= b):
            starts.insert(at, a)
            taken.insert(at, (k, a, b))
    return taken
