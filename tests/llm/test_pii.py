import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideql.llm import pii, tagger

MODEL = tagger.trained()


def plain_base(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(d):
        odd = sum(map(int, d[-1::-2]))
        return (odd + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-_+1234 ()é\n", max_size=40))
def test_base_on_random_texts(text):
    assert pii.base_spans(text) == plain_base(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "10.0.0.255", "256.1.1.1", "a@b.co", "+1 (234) 555-6789", ".", "@", "1", " ", "-", "x_", "+"]), max_size=8))
def test_base_on_joined_parts(parts):
    assert pii.base_spans("".join(parts)) == plain_base("".join(parts))


def test_base_is_linear_on_long_runs():
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    m = tagger.Tagger(3)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    m.free = m.free.astype(np.float64)
    ids = rng.integers(0, tagger.CLASSES, (2, 7))
    tags = np.array([[0, 1, 2, 2, 0, 3, 4], [2, 0, 0, 7, 8, 0, 5]])
    loss, g = m.gradients(ids, tags)
    for k in ("xf", "xb", "hf", "hb", "o", "c", "t"):
        for _ in range(3):
            at = (int(ids[0, 2]),) + (int(rng.integers(0, 4 * tagger.HIDDEN)),) if k[0] == "x" else tuple(int(rng.integers(0, n)) for n in m.w[k].shape)
            if k == "t" and m.free[at]:
                continue
            keep, got = m.w[k][at], []
            for step in (1e-3, -1e-3):
                m.w[k][at] = keep + step
                got.append(m.gradients(ids, tags)[0])
            m.w[k][at] = keep
            assert g[k][at] == pytest.approx((got[0] - got[1]) / 2e-3, rel=0.05, abs=2e-4), k


def test_decoding_is_the_best_of_all_paths():
    from itertools import product

    m, ids = tagger.Tagger(5), np.random.default_rng(2).integers(0, tagger.CLASSES, (1, 4))
    e, move = m.emissions(ids)[:, 0], m.w["t"] + m.free
    score = lambda p: move[tagger.TAGS, p[0]] + sum(e[t, x] for t, x in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
    assert tuple(m.decode(ids)[0]) == max(product(range(tagger.TAGS), repeat=4), key=score)


def test_tagger_on_made_up_texts():
    rng, hit, wrong, missed = random.Random(99), 0, 0, 0
    for _ in range(150):
        text, spans = tagger.example(rng)
        got = set(tagger.found(MODEL, text))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.88 and hit / (hit + missed) > 0.9


def test_windows_are_reconciled_over_the_text():
    filler = "the ouly thing an inest " * 3
    for shift in range(0, tagger.WIDTH, 7):
        text = "x" * shift + " " + filler + "call (555) 123-4567 now " + filler
        a = text.index("(555)")
        assert (3, a, a + 14) in tagger.found(MODEL, text)
    assert tagger.reconciled([(-5, -10, 0, 1, 10), (-9, -4, 8, 0, 12), (-9, -4, 8, 0, 12), (-5, -3, 12, 2, 15)]) == [(0, 8, 12), (2, 12, 15)]


def test_added_spans_keep_base_ones_and_leave_clean_texts_alone():
    texts = ["write to john.doe (at) example (dot) org or call 555-123-4567, a@b.co", "The price was 1,234.50 on 2024-01-02 at 12:30, version 1.2.3", "nothing at all here", None]
    got = pii.all_spans(texts, MODEL)
    assert [plain_base(t) for t in texts] == [b for b, _ in got]
    assert all(set(b) <= set(e) for b, e in got) and len(got[0][1]) >= 2
    assert got[1][1] == got[2][1] == got[3][1] == []
    assert pii.masked(texts[0], [(0, 9, 39), (3, 48, 60), (3, 50, 55)]).startswith("write to [EMAIL]")


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r["doc_id"]])
        joined = ",".join(f"{tagger.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in tagger.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert {x for x in joined.split(",") if x} <= set(r["spans"].split(","))


def test_edges_of_the_input(spark):
    rows = [(1, None, 7, "x"), (None, "", 0, "x"), (2, "a@b.co " * 3000, 1, None), (2, "a@b.co " * 3000, 1, None), (3, "1 2 " * 20_000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = sorted(((r["doc_id"], r["n_email"]) for r in pii.marked(docs).collect()), key=str)
    assert got == sorted([(1, 0), (None, 0), (2, 3000), (2, 3000), (3, 0)], key=str)
    new = pii.redacted(docs)
    assert new.schema.names == docs.columns
    by = {r["doc_id"]: r for r in new.collect()}
    assert by[1]["text"] is None and by[1]["n_chars"] is None and by[2]["text"] == "[EMAIL] " * 3000 and by[2]["n_chars"] == 24_000
    assert pii.marked(docs.limit(0)).count() == pii.redacted(docs.limit(0)).count() == 0


def forms(rng):
    """(kind, text) of every disguise that the made-up training texts show, by name."""
    word = lambda: tagger._word(rng).replace("é", "e")
    digits = lambda n: tagger._digits(rng, n)
    name, end, out = rng.choice([word, lambda: f"{word()}.{word()}", lambda: f"{word()}_{rng.randrange(99)}"]), rng.choice(tagger._ENDINGS), {}
    for at, dot in [("@", "."), (" @ ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" [at] ", "."), (" AT ", " DOT ")]:
        out[f"email{at}{dot}"] = (0, name() + at + word() + dot + end.replace(".", dot))
    for sep in (".", " . ", "[.]", " dot "):
        out[f"ip{sep}"] = (1, sep.join(str(rng.randrange(256)) for _ in range(4)))
    for sep in ("", " ", "-", ".", "  ", " - ", "_"):
        card = rng.choice("3456") + digits(rng.choice([12, 13, 14, 16]))
        card += next(x for x in "0123456789" if tagger.luhn(card + x))
        out[f"card{sep}"] = (2, sep.join(card[i : i + 4] for i in range(0, len(card), 4)))
    a, b, c, k = digits(3), digits(3), digits(4), rng.randrange(1, 99)
    phones = [f"+{k} ({a}) {b}-{c}", f"+{k} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.randrange(11, 99)} {a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"+{k}{a}{b}{c}", f"0{digits(2)}/{b}{c}"]
    return out | {f"phone{i}": (3, x) for i, x in enumerate(phones)}


def test_every_form_alone_is_found_as_if_all_windows_were_decoded():
    rng, hit, texts = random.Random(5), {}, []
    for _ in range(300):
        for form, (kind, part) in forms(rng).items():
            before, after = (" ".join(tagger._word(rng) for _ in range(rng.randrange(5, 30))) for _ in "ab")
            text = before + " " + part + rng.choice([" ", ", ", ". ", "\n"]) + after
            texts.append((form, text, (kind, len(before) + 1, len(before) + 1 + len(part))))
    got = pii.all_spans([t for _, t, _ in texts], MODEL)
    for (form, _, span), (base, spans) in zip(texts, got):
        # what the patterns take for another kind stays theirs
        hit.setdefault(form, []).append(span in spans or pii._covered(base, span))
    assert {f: sum(x) / len(x) for f, x in hit.items() if sum(x) < 0.9 * len(x)} == {}
    some = [t for _, t, _ in texts[::3]]
    assert pii.all_spans(some, MODEL, every=True) == pii.all_spans(some, MODEL)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["john", "a.b", "(", ")", "[", "]", " ", "at", "AT", "dot", ".", "com", "-", "_", "12", "4111", "+"]), max_size=14), st.integers(0, 40), st.integers(1, 40))
def test_what_holds_no_trigger_is_never_settled(parts, a, length):
    text = "".join(parts)
    a = min(a, len(text))
    b = min(len(text), a + length)
    for kind in range(4):
        span = pii.settled(kind, text, a, b)
        if span:
            assert any(a <= m.start() < b for m in tagger.TRIGGER.finditer(text)), (kind, text, a, b)
            assert span[0] == kind and 0 <= span[1] < span[2] <= len(text)


def test_marked_spans_are_mended_at_their_edges():
    text = "write john.doe [at] mail.example.com today, or card 4111 1111 1111 1111 and 7 more, 555-123-4567."
    for part, kind in (("john.doe [at] mail.example.com", 0), ("4111 1111 1111 1111", 2), ("555-123-4567", 3)):
        a = text.index(part)
        b = a + len(part)
        for left in (-3, 0, 2):
            for right in (-2, 0, 1):
                assert pii.settled(kind, text, a + left, b + right) == (kind, a, b), (part, left, right)
    assert pii.settled(2, text, text.index("4111"), text.index("4111") + 4) is None
    assert pii.settled(0, text, text.index("mail"), text.index("mail") + 8) is None
    assert pii.settled(0, "mail a at b dot com dot au now", 5, 15) == (0, 5, 19)
    assert pii.settled(0, "mail a at b dot com dot au now", 5, 22) == (0, 5, 26)


def test_long_addresses_at_every_offset():
    mail = "firstname.lastname (at) department.faculty.of.many.things.university-of-somewhere (dot) edu"
    filler = "the ouly thing an inest " * 4
    for shift in range(0, tagger.WIDTH, 5):
        text = filler + "x" * shift + " write to " + mail + " soon, " + filler
        a = text.index(mail)
        assert any(k == 0 and x <= a and a + len(mail) <= y for k, x, y in pii.all_spans([text], MODEL)[0][1]), shift


def test_added_spans_may_reach_over_base_ones():
    assert not pii._covered([(2, 5, 20)], (3, 4, 20)) and pii._covered([(2, 5, 20)], (3, 5, 20)) and pii._covered([(1, 0, 9), (2, 9, 20)], (3, 5, 20))
    text = "mail to jo@hn (at) example (dot) com or the like of that thing"
    spans = [(0, 8, 36), (0, 8, 13)]
    assert pii.masked(text, spans) == "mail to [EMAIL] or the like of that thing"
