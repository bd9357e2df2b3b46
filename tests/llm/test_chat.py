from tideql.llm import chat


def plain(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append((turn, role, text))
    key = lambda t: [(x is not None, x) if x is not None else (False, 0) for x in t]
    convs = {c: [(r, x) for _, r, x in sorted(t, key=key)] for c, t in convs.items()}
    ids = lambda c: (c is not None, c or 0)
    kept = {
        c: t
        for c, t in convs.items()
        if not any((len(u) > len(t) and u[: len(t)] == t) or (u == t and c is not None and d is not None and d < c) for d, u in convs.items() if d != c)
    }
    return sorted((c, len(t), "".join(f"<|{r or 'unknown'}|>\n{x or ''}\n<|end|>\n" for r, x in t)) for c, t in sorted(kept.items(), key=lambda i: ids(i[0])))


def test_snapshots_collapse(spark):
    log = ["hi", "hello", "more", "sure", "thanks"]
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", log[i]) for c, n in ((5, 2), (3, 5), (4, 5), (9, 1)) for i in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "system", "hi"), (8, 0, "user", "hi hello"), (8, 0, "user", "hi hello")]
    rows += [(10, None, "user", "hi"), (10, 1, None, "x"), (11, 0, "user", None), (12, 0, "user", ""), (13, 0, None, "null text"), (14, 0, "unknown", "null text")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, keys string")
    assert sorted(map(tuple, chat.rendered(df).collect())) == plain(rows)
    assert chat.rendered(df.limit(0)).count() == 0


def test_a_conversation_without_an_id_and_one_long_one(spark):
    rows = [(None, i, "user", f"t{i}") for i in range(3)] + [(1, i, "user", f"t{i}") for i in range(2)] + [(2, i, "user", "x" * 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(((r["conv_id"], r["n_turns"]) for r in chat.rendered(df).collect()), key=str) == [(2, 500), (None, 3)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, chat.query(spark, sf).collect())) == plain(rows)


def test_work_is_linear_in_turns(spark):
    import time

    took = []
    for n in (5_000, 40_000, 80_000):
        df = spark.range(n).selectExpr("1L conv_id", "id turn", "'user' role", "concat('t', id) text")
        df = df.union(df.where(f"turn < {n - 1}").selectExpr("2L conv_id", "turn", "role", "text"))
        began = time.time()
        assert [(r["conv_id"], r["n_turns"]) for r in chat.collapsed(df).select("conv_id", "n_turns").collect()] == [(1, n)]
        took.append(time.time() - began)
    assert took[2] < 2 * took[1] + 1
