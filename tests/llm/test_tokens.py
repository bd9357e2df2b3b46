import random

import pytest

from tideql.llm import tokens


def reference_counter(pieces):
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0)] + pieces
    low = min(s for _, s in pieces)
    vocab += [(f"<0x{b:02X}>", low) for b in range(256)]
    model = Tokenizer(models.Unigram(vocab, 0, True))
    return lambda w: len(model.encode(tokens.SPACE + w, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(4))
def test_words_against_the_tokenizer(seed):
    rng = random.Random(seed)
    letters = "abcé"
    pieces = {tokens.SPACE: -1.0}
    for _ in range(40):
        pieces["".join(rng.choice(letters + tokens.SPACE) for _ in range(rng.randrange(1, 5)))] = -float(rng.randrange(1, 6))
    pieces = list(pieces.items())
    want, counter = reference_counter(pieces), tokens.TokenCounter(pieces)
    for _ in range(300):
        word = "".join(rng.choice(letters + "z漢") for _ in range(rng.randrange(1, 14)))
        assert counter.word(word) == want(word), (word, pieces)


def test_documents_against_the_tokenizer(spark):
    pieces = tokens.vocabulary()
    want = reference_counter(pieces)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    cache = {}
    for r in tokens.query(spark, "/root/testdata/sf0.001").collect():
        words = texts[r["doc_id"]].encode().split()
        assert r["n_words"] == len(words)
        assert r["n_tokens"] == sum(cache.setdefault(w, want(w.decode())) if w not in cache else cache[w] for w in words)


def test_edges_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 2)
    rows = [(1, None), (2, ""), (None, "abc abc"), (3, "x" * 100_000 + " y"), (3, "x" * 100_000 + " y")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int")
    got = tokens.counted(docs, [("▁", -1.0), ("x", -2.0), ("xx", -3.0)]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0), (2, 0, 0), (None, 2, 8), (3, 2, 50_003), (3, 2, 50_003)], key=str)
    assert tokens.counted(docs.limit(0), [("▁", -1.0)]).count() == 0
