import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tideql.llm import simhash
from tideql.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbBé \t\n\x0bxyz ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_nothing_and_long_texts(monkeypatch):
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    text = " ".join(f"w{i % 97} q{i % 13}" for i in range(300))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 60).astype(np.uint64)
    fps = [0, 2**64 - 1, 1, 3, 7]
    for s in seeds.tolist():
        x = s
        for _ in range(6):
            fps.append(x)
            for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                x ^= 1 << b
    fps = sorted(set(fps))
    rng.shuffle(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = plain_components(fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for chunk in (4096, 2):
        found = {r["node"]: r["root"] for r in components(simhash.links(df, chunk=chunk)).collect()}
        groups = lambda label: sorted(sorted(signed[i] for i in range(len(fps)) if label(i) == k) for k in {label(i) for i in range(len(fps))})
        assert groups(lambda i: found.get(signed[i], signed[i])) == groups(lambda i: want[i])


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(fps)
    least = {}
    for (i, _), k in zip(rows, label):
        least[k] = min(i, least.get(k, i))
    want = sorted((i, f"{fp:016x}", least[k]) for (i, _), fp, k in zip(rows, fps, label))
    assert sorted(map(tuple, simhash.query(spark, "/root/testdata/sf0.001").collect())) == want


def test_edges_of_the_input(spark):
    rows = [(1, "a b c d"), (2, "A b C d"), (2, "A b C d"), (3, None), (4, ""), (None, "a b c d"), (None, "z"), (5, "one two")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted([(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (None, 1), (None, None), (5, 5)], key=str)
    kept = [r["doc_id"] for r in simhash.representatives(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 5, None, None], key=str)
    assert simhash.representatives(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("n", [0, 1])
def test_forest_of_few(n):
    node, root = simhash.forest(np.zeros(0, int), np.zeros(0, int), n)
    assert len(node) == len(root) == 0


@pytest.mark.parametrize("rows,want", [([(2, "B"), (5, "B"), (5, "A")], {(2, "B"), (5, "A")}), ([(5, "A"), (5, "B"), (7, "A")], {(5, "A"), (5, "B")}), ([(1, "A"), (1, "A"), (None, "A")], {(1, "A"), (None, "A")})])
def test_representatives_lose_no_distinct_text(spark, rows, want):
    texts = {"A": "one two three four five six", "B": "quite another text with other words"}
    docs = spark.createDataFrame([(i, texts[t], n, {"k": t}) for n, (i, t) in enumerate(rows)], "doc_id int, text string, n_chars long, more map<string,string>")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(((i, texts[t]) for i, t in want), key=str)


def test_copies_of_one_text_are_not_dealt_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_HOT", 5)
    rows = [(i, "the same text for all of these") for i in range(40)] + [(100 + i, f"text number {i} of many {i * i}") for i in range(30)] + [(7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).where("fingerprint <> '0000000000000000'").collect()}
    assert all(got[i] == 0 for i in range(40)) and len(got) == 70


def test_fine_tiles_hold_every_link_once():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = [f ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for f in fps for a, b in rng.integers(0, 64, (4, 2))]
    every = np.unique(np.concatenate([fps, np.array(near, np.uint64)])).view(np.int64)
    tiles = np.unique(simhash._quarters(simhash.bytes_of(every)) @ simhash._RADIX)
    for split in (tiles[:0], tiles, tiles[::2]):
        tile, home, value = simhash.visited(every, 2, split)
        assert home.sum() == len(every)
        met = {}
        for t, h, v in zip(tile.tolist(), home.tolist(), value.tolist()):
            met.setdefault(t, ([], []))[0 if h else 1].append(v)
        pairs = [tuple(sorted(p)) for homes, others in met.values() for i, x in enumerate(homes) for p in [(x, y) for y in homes[:i]] + [(x, y) for y in others]]
        assert len(pairs) == len(set(pairs))
        links = {tuple(sorted((x, y))) for i, y in enumerate(every.tolist()) for x in every[:i].tolist() if bin((x ^ y) & (2**64 - 1)).count("1") <= 2}
        assert links <= set(pairs) and len(links) > 50
