import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from tideql.llm import attention, lm


def plain(rows):
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w] + [" "]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows), key=str)


def checked(rows, got):
    got = sorted((tuple(r) for r in got), key=lambda r: str(r[:6]))
    got = sorted(got, key=lambda r: str((r[0], r[1], r[2], r[3], r[4])))
    want = sorted(plain(rows), key=lambda r: str(r[:5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert sorted(r[5] for r in got) == pytest.approx(sorted(r[5] for r in want))
    return got


@pytest.mark.parametrize("hot", [200_000, 50])
def test_base_against_brute_force_and_the_model_beats_it(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = checked(rows, lm.query(spark, "/root/testdata/sf0.001").collect())
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def plain_log10(m, before, classes):
    """Log10 probabilities of classes after ids, by the formulas, one place at a time."""
    place = attention.CONTEXT + (len(before) % attention.BLOCK)
    seen = [attention.START] * attention.WIDTH + list(before)
    m = {k: v.astype(np.float64) for k, v in m.items()}
    x = m["e"][seen[-(place + 1) :]] + m["p"][: place + 1]
    a = np.exp(x[-1] @ m["q"] @ (x @ m["k"]).T / np.sqrt(attention.DIM))
    h = x[-1] + (a / a.sum()) @ (x @ m["v"]) @ m["o"]
    soft = lambda z: z - np.log(np.exp(z).sum())
    g, k = np.divmod(np.atleast_1d(classes), attention.MEMBERS)
    first = soft(h @ m["g"] + m["gb"])
    return np.array([first[i] + soft(h @ m["u"][i] + m["b"][i])[j] for i, j in zip(g, k)]) / np.log(10)


def rough(seed=0):
    model = attention.initial(np.random.default_rng(seed).dirichlet(np.ones(attention.CLASSES)), seed)
    for k in "gu":
        model[k] *= 20
    return model


def test_every_token_is_predicted_once_from_the_tokens_before_it():
    rng, model = np.random.default_rng(0), rough()
    scorer = attention.Scorer(model)
    every = []
    for n in (1, 2, 15, 39, 40, 41, 80, 100, 300):
        tokens, classes = rng.integers(0, 999, n).astype(np.uint16), rng.integers(0, attention.CLASSES, n)
        starts = rng.random(n) < 0.5
        starts[0] = True
        want = [plain_log10(model, tokens[:t], classes[t])[0] for t in np.flatnonzero(starts)]
        for most in (1 << 30, 80):
            got = [scorer(*one) for one in attention.streams(tokens, classes[starts], starts, most)]
            assert np.concatenate(got) == pytest.approx(want, abs=1e-4)
        every.append((next(attention.streams(tokens, classes[starts], starts)), want))
    together = scorer(*(np.concatenate(x) for x in zip(*(one for one, _ in every))))
    assert together == pytest.approx(np.concatenate([w for _, w in every]), abs=1e-4)
    assert (10 ** plain_log10(model, tokens, np.arange(attention.CLASSES))).sum() == pytest.approx(1)
    # without the bounds on exponents the same comes out
    scorer.safe, scorer.bias = False, 1e9
    assert scorer(*every[-1][0]) == pytest.approx(every[-1][1], abs=1e-4)


def test_training_windows_hold_every_word_once():
    rng = np.random.default_rng(2)
    for n in (1, 2, 79, 80, 81, 500):
        tokens, classes = rng.integers(0, 999, n).astype(np.uint16), rng.integers(0, attention.CLASSES, n)
        starts = rng.random(n) < 0.4
        starts[0] = True
        for shift in (0, 1, 79):
            ids, target, mask = attention.windows(tokens, classes[starts], starts, shift)
            assert ids.shape == target.shape == mask.shape and ids.shape[1] == attention.WIDTH
            assert target[mask].tolist() == classes[starts].tolist()
            at = np.flatnonzero(mask.ravel())
            assert ids.ravel()[at].tolist() == [attention.START if t == 0 else tokens[t - 1] for t in np.flatnonzero(starts)]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in rough(1).items()}
    classes = rng.choice([3, 70, 71, 500, 1023], 90)
    ids, target, mask = attention.windows(rng.integers(0, 9, 200).astype(np.uint16), classes, np.arange(200) % 20 < 9, 7)
    _, g = attention.gradients(model, ids, target, mask)
    seen, rows = g["e"]
    g["e"] = np.zeros(attention.SHAPES["e"])
    g["e"][seen] = rows
    places = {"e": [(i, 3) for i in (0, 5, attention.START)], "u": [(0, 2, 3), (1, 5, 6), (7, 1, 52), (15, 3, 63)], "b": [(0, 3), (1, 7), (15, 63), (2, 0)]}
    for k in attention.SHAPES:
        for at in places.get(k) or [tuple(rng.integers(0, n) for n in attention.SHAPES[k]) for _ in range(4)]:
            keep, loss = model[k][at], []
            for step in (1e-4, -1e-4):
                model[k][at] = keep + step
                loss.append(attention.gradients(model, ids, target, mask)[0])
            model[k][at] = keep
            assert g[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=2e-2, abs=2e-5), k


def test_training_learns_an_order():
    trainer = attention.Trainer(attention.initial(np.full(attention.CLASSES, 1 / attention.CLASSES)), 0)
    order = np.tile(np.arange(5), 20)
    for _ in range(30):
        for _ in range(400):
            trainer.add(order.astype(np.uint16), order * 200)
        trainer.train()
    one = next(attention.streams(order.astype(np.uint16), order * 200))
    assert attention.Scorer(trainer.model)(*one).mean() > -0.3


def test_scores_against_brute_force(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(lm, "trained", lambda texts, classes, real=lm.trained: kept.update(model=real(texts, classes), classes=classes) or kept["model"])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(5, None), (5, None), (None, "New  Words")]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    with open(lm.VOCABULARY, "rb") as f:
        pieces = lm.pieces_of(f.read())
    c = Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in lm.tokens_of((t or "").encode()))
    classes = kept["classes"]
    assert classes.size.sum() == sum(c.values()) + len(c) + attention.CLASSES
    want = []
    for i, t in rows:
        before, total = [], 0.0
        for w in lm.tokens_of((t or "").encode()):
            ids = [lm.END_ID] if w == lm.END else pieces(w) or [lm.OTHER_ID]
            y = classes.by_id[ids[0]]
            total += plain_log10(kept["model"], before, y)[0] + np.log10((c[w] + 1) / classes.size[y])
            before += ids
        want.append((str(i), len(lm.tokens_of((t or "").encode())), total))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got)
    want.sort()
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], rel=1e-4)


def test_means_of_many_sets_of_weights(spark):
    sets = [(np.full(sum(int(np.prod(s)) for s in attention.SHAPES.values()), i, np.float32).tobytes(), i + 1) for i in range(20)]
    got = lm._mean(spark.createDataFrame(sets, "model binary, n long").repartition(5))
    assert all(np.allclose(got[k], sum(i * (i + 1) for i in range(20)) / 210) for k in attention.SHAPES)
    assert lm._mean(spark.createDataFrame([], "model binary, n long")) is None


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (None, "A a é"), (3, "a b " * 30_000), (3, "a b " * 30_000), (16, "new word"), (4, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    got = checked(rows, lm.scored(docs).collect())
    assert all(np.isfinite(r[6]) for r in got)
    assert lm.scored(docs.limit(0)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = lm.scored(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert [tuple(r)[:6] for r in only] == [(held, True, 3, 0, 0, 0.0)] and only[0]["score"] < 0


def test_all_subwords_of_a_word_are_read():
    with open(lm.VOCABULARY, "rb") as f:
        raw = f.read()
    same = "antidisestablishmentarian"
    words = [same + "ism", same + "s", "x" * 5000 + "yz", "東京都" * 300, "plain"]
    leads = sorted({lm.lead_of(raw)(w.encode()) for w in words})
    classes = lm.Classes([(x, 1, 1) for x in leads], 1)
    for hot in ([], [w.encode() for w in words]):
        reader = lm.Reader(raw, hot)
        number, cold, ids, starts = reader(" ".join(words).encode())
        assert len(number) == starts.sum() == len(words) + 1 and len(cold) == (1 if hot else len(words) + 1)
        assert lm._encoding(lm.hashlib.sha256(raw).hexdigest()[:16], raw).decode(ids[:-1].tolist()) == " " + " ".join(words)
        assert classes.by_id[ids[starts]].tolist()[-1] == lm.END_CLASS and [i for i, x in enumerate(ids[starts][:-1]) if classes.by_id[x] == lm.REST_CLASS] == []
    before = [reader(f"{w} next".encode())[2].tolist() for w in words[:2]]
    assert before[0] != before[1]
    scorer, got = attention.Scorer(rough()), []
    for w in words[:2]:  # alike in their first 16 characters
        _, _, ids, starts = reader(f"{w} plain".encode())
        got.append(scorer(*next(attention.streams(ids, classes.by_id[ids[starts]], starts))))
    assert got[0][0] == got[1][0] and got[0][1] != got[1][1]
    assert attention.CLASSES >= 255


def test_every_training_document_trains_the_attention(spark, monkeypatch):
    rows = [(i, f"word{i} again") for i in range(40)] + [(None, "no id"), (None, "no id")]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    seen = []
    real = lm._mean
    monkeypatch.setattr(lm, "_mean", lambda models: seen.append(sum(r["n"] for r in models.collect())) or real(models))
    lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(seen) == lm.ROUNDS and held.count(False) <= sum(seen) <= 2 * held.count(False)
    # a table of one document trains on it
    seen.clear()
    learnt = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2)
    lm.scored(spark.createDataFrame([(learnt, "one text")], "doc_id long, text string")).collect()
    assert sum(seen) >= 1


ODD = [None, b"", b" ", b"\xff\xfe a\xc3 b", "a\u00a0b a\u3000 x\u2028y \x1cq \x85 z".encode(), b"x" * 5000 + b" foo", "東京都".encode() * 300, b"A\x0bB\x0cC\x1fD's 'll 12345 don't\n\n\t$%", "é \u0301 \u200d a\u200b".encode(), b"b"]


@pytest.mark.parametrize("hot", [[], [b"a", b"b", b" ", b"x" * 64]])
def test_many_texts_are_read_as_each_alone(hot):
    with open(lm.VOCABULARY, "rb") as f:
        raw = f.read()
    reader, one = lm.Reader(raw, hot), lm.pieces_of(raw)
    words, code, number, n, ids, each = reader.many(ODD)
    assert list(lm._together([b"ab", None, b"c", b"d" * 9, b""], 3)) == [(0, 3), (3, 4), (4, 5)] and list(lm._together([])) == []
    want = [w for t in ODD for w in lm.tokens_of(t)]
    assert n.tolist() == [len(lm.tokens_of(t)) for t in ODD]
    assert words.take(lm.pa.array(code)).to_pylist() == want and len(set(words.to_pylist()[:-1])) == len(words) - 1
    assert number.tolist() == [hot.index(w) if w in hot else -1 for w in want]
    want = [[lm.END_ID] if w == lm.END else one(w) for w in want]
    assert each.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_large_scores_are_shifted_and_unused_vectors_do_not_matter():
    rng, model = np.random.default_rng(3), rough(3)
    tokens, classes = rng.integers(0, 999, 100).astype(np.uint16), rng.integers(0, attention.CLASSES, 100)
    one = next(attention.streams(tokens, classes))
    asked = []
    model["e"][60_000] = 1e6  # in no text
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(attention, "_mild", lambda z, real=attention._mild: asked.append(real(z)) or asked[-1])
        got = attention.Scorer(model)(*one)
    assert asked and all(asked)
    assert got == pytest.approx([plain_log10(model, tokens[:t], classes[t])[0] for t in range(100)], abs=1e-4)
    for k in "qgu":
        model[k] *= 30
    got = attention.Scorer(model)(*one)
    assert np.isfinite(got).all()
    assert got == pytest.approx([plain_log10(model, tokens[:t], classes[t])[0] for t in range(100)], rel=1e-2, abs=1e-2)
    _, g = attention.gradients(model, *attention.windows(tokens, classes))
    assert all(np.isfinite(x).all() for k, x in g.items() if k != "e") and np.isfinite(g["e"][1]).all()


def test_freed_memory_stays_with_a_worker():
    code = """
import resource
import numpy as np
from tideql.llm import common
if hasattr(common, "keep_memory"):
    common.keep_memory()
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for i in range(40):
    if i == 20:
        before = faults()
    arrays = [np.ones(1 << 17) for _ in range(20)]
    del arrays
print((faults() - before) // 20)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(got.stdout) < 200  # pages a round, of 5,120
