import hashlib
import random
import re

from tideql.llm import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(x) for x in wins}
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    ids |= found
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_random_passages_of_all_lengths(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "É", "x9", "Stra", "ße"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ".", "-"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 4, 5, 6, 12, 13, 14, 30, 30, 60])]
    items += [(20, items[8][1]), (21, None), (22, "")]
    for short in (0, 3, 6):  # with and without items of a few words
        use = items[short:]
        docs = []
        for i in range(60):
            parts = [" ".join(f"u{rng.randrange(99)}" for _ in range(rng.randrange(40)))]
            for _ in range(rng.randrange(3)):
                w = (rng.choice(use)[1] or "").split(" ")
                k = rng.randrange(len(w))
                parts += [" ".join(w[k:] if rng.random() < 0.5 else w), " ".join(f"u{rng.randrange(99)}" for _ in range(rng.randrange(30)))]
            docs.append((i, " ".join(parts)))
        got = decontaminate.verdicts(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(use, "item_id long, text string"))
        assert sorted(map(tuple, got.collect()), key=str) == plain(docs, use)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, decontaminate.query(spark, sf).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", 0)
    assert sorted(map(tuple, decontaminate.query(spark, sf).collect())) == whole


def test_edges_of_the_input(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    docs = [(1, None), (2, ""), (3, passage.upper()), (3, passage.upper()), (None, passage + " x" * 300), (4, " ".join(passage.split()[:12])), (5, f"{passage} y " * 2000)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n int, items string")
    bench = spark.createDataFrame([(None, passage), (7, passage), (8, None)], "item_id long, text string")
    every = decontaminate.verdicts(df, bench).collect()
    assert len(every) == len(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in every}
    ids = hashlib.sha256(b"7").hexdigest()
    assert got[3] == (15, 15, 1, ids, True) and got[None] == (315, 15, 1, ids, False)
    assert got[1] == got[2] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), False) and got[4][1] == 0
    assert got[5] == (32000, 30000, 1, ids, True)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted([1, 2, None, 4], key=str)
    assert decontaminate.verdicts(df.limit(0), bench).count() == 0
    assert decontaminate.verdicts(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == len(docs)
