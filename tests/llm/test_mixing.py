from collections import Counter

import pytest

from tideql.llm import mixing


def docs_of(spark, sizes):
    rows = [(i, f"t{i}", s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    return spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, source string, shuffle_key int, copy string")


def test_shares_reach_their_targets(spark):
    docs = docs_of(spark, {"a": 4000, "b": 300, None: 200, "d": 30})
    got = mixing.mixed(docs, {"a": 1.0, "b": 1.0, None: 2.0}, epochs=2.0)
    assert got.columns == [*docs.columns, "copy_", "shuffle_key_"]
    n = Counter(r["source"] for r in got.select("source").collect())
    assert n["d"] == 0
    for source, share in (("a", 0.25), ("b", 0.25), (None, 0.5)):
        assert n[source] == pytest.approx(2 * 4530 * share, rel=0.06)


def test_copies_are_poisson(spark):
    docs = docs_of(spark, {"a": 3000})
    n = Counter(r["doc_id"] for r in mixing.mixed(docs, epochs=1.5).select("doc_id").collect())
    counts = Counter(n.get(i, 0) for i in range(3000))
    p = 2.718281828459045**-1.5
    for k in range(5):
        assert counts[k] == pytest.approx(3000 * p, abs=5 * (3000 * p) ** 0.5)
        p *= 1.5 / (k + 1)


def test_large_means_and_no_broadcast(spark, monkeypatch):
    docs = docs_of(spark, {"a": 5, "b": 1995})
    whole = sorted(map(str, mixing.mixed(docs).collect()))
    n = Counter(r["source"] for r in mixing.mixed(docs).collect())
    assert n["a"] == pytest.approx(1000, abs=160) and n["b"] == pytest.approx(1000, abs=160)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mixed(docs).collect())) == whole
    copies = mixing.mixed(docs).select("doc_id", "copy_").collect()
    assert len(set(copies)) == len(copies)


def test_order_and_edges(spark):
    docs = docs_of(spark, {"a": 400, "b": 400})
    order = [r["source"] for r in mixing.mixed(docs).collect()]
    assert 100 < sum(x != y for x, y in zip(order, order[1:])) < 700
    odd = spark.createDataFrame([(None, None, None), (1, "", "s"), (1, "", "s")], "doc_id long, text string, source string")
    got = Counter(map(tuple, mixing.mixed(odd, epochs=20.0).select("doc_id", "source", "copy").collect()))
    assert {k for k in got} and all(v == (2 if k[0] == 1 else 1) for k, v in got.items())
    assert mixing.mixed(odd.limit(0)).count() == 0
