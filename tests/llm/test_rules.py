import re
from collections import Counter

import pytest

from tideql.llm import rules


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    symbols, chars, lines = len(re.findall(r"[#*$%&|<>]", text)), sum(map(len, words)), sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    broken = (len(words) < 50, 100 * len(hit) > 50 * len(words), 10 * symbols > len(words), 10 * dup > 3 * lines, chars < 2 * len(words) or chars > 12 * len(words))
    return (len(words), chars, symbols, dup, len(hit), failed), broken


def plain_rates(rows):
    """Shrunk rates of each rule by host; rows: (host, broken)."""
    n, rates = Counter(h for h, _ in rows), {}
    for k in range(5):
        bad = Counter(h for h, broken in rows if broken[k])
        mean, share = sum(bad.values()) / len(rows), [bad[h] / n[h] for h in n]
        v = sum((s - sum(share) / len(n)) ** 2 for s in share) / len(n) - mean * (1 - mean) * sum(1 / n[h] for h in n) / len(n)
        weight = min(max(mean * (1 - mean) / v - 1, 1), 1000) if v > 0 else 1000
        for h in n:
            rates.setdefault(h, []).append((bad[h] + mean * weight) / (n[h] + weight))
    return rates


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_measures_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = {r["doc_id"]: (*plain(r["text"]), r["source"]) for r in docs.collect()}
    got = rules.query(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(want)
    rates = plain_rates([(source, broken) for _, broken, source in want.values()])
    for r in got:
        p, _, source = want[r["doc_id"]]
        assert tuple(r[k] for k in NAMES) == p
        assert r["host_rate"] == pytest.approx(max(rates[source]), abs=1e-8)
        assert r["kept"] == (not p[5] and r["host_rate"] <= 0.5)


@pytest.mark.parametrize("bits", [8, 1])
def test_repeats_are_settled_by_the_words(spark, monkeypatch, bits):
    monkeypatch.setattr(rules, "HASH_BITS", bits)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(-1, "a b c a b c d a b", "x"), (-2, " ".join(f"w{i % 700}" for i in range(900)), "x")], docs.schema))
    want = {r["doc_id"]: plain(r["text"])[0] for r in docs.collect()}
    for r in rules.judged(docs).collect():
        assert tuple(r[k] for k in NAMES) == want[r["doc_id"]]


def test_any_rule_can_reject_a_host(spark):
    good = " ".join(f"w{i}" for i in range(60))
    bad = {"symbols": good + " #*$%&|<>" * 3, "lines": "\n".join([good] + ["same line here"] * 5 + [good[::-1]]), "length": " ".join(f"{i}" * 20 for i in range(10, 70))}
    rows = [(f"good{h}", good) for h in range(10) for _ in range(20)] + [(h, t if i else good) for h, t in bad.items() for i in range(40)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rules.judged(docs).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert all(got[i]["kept"] == h.startswith("good") for i, (h, _) in enumerate(rows))


def test_bad_hosts_lose_their_documents_and_small_hosts_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "few words"
    rows = [(f"good{h}", good if i else bad) for h in range(20) for i in range(20)] + [("spam", bad if i else good) for i in range(40)] + [("tiny", bad), (None, good)]
    docs = spark.createDataFrame([(i, t, h, "x") for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, rate string")
    got = {r["doc_id"]: r for r in rules.judged(docs).collect()}
    assert len(got) == len(rows)
    for i, (h, t) in enumerate(rows):
        assert got[i]["kept"] == (t == good and h != "spam"), (h, got[i])
    tiny = next(got[i] for i, (h, _) in enumerate(rows) if h == "tiny")
    assert tiny["host_rate"] < 0.9


def test_edges_of_the_input(spark):
    text = "a b c a b c\n \na b c\na b c\n\x0b#*<é>\r\n"
    rows = [(1, None, "s"), (None, "", "s"), (2, text, None), (2, text, None), (3, "x y z " * 40_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted([tuple(r[k] for k in ["doc_id", *NAMES]) for r in rules.judged(docs).collect()], key=str)
    assert got == sorted([(i, *plain(t)[0]) for i, t, _ in rows], key=str)
    assert rules.judged(docs.limit(0)).count() == 0
