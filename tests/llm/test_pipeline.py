from collections import Counter

import corpus_pipeline
from tests.llm import test_decontaminate, test_pii, test_simhash
from tideql.llm import mixing, pii, quality
from tideql.llm.common import table, written

SF = "/root/testdata/sf0.001"
LAST: list = []


def rows(df):
    return sorted((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in df.collect())


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = table(spark, SF, "documents")
    names, labels = docs.columns, table(spark, SF, "labels")
    benchmark = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        docs = written(stage(spark, docs, SF), name)
        got = rows(docs)
        if name == "quality_classifier":
            score = quality.trained(table(spark, SF, "documents"), labels)
            import numpy as np

            keep = score.score(np.array([quality.statistics(r[1]) for r in before])) >= 0.5
            want = [r for r, k in zip(before, keep) if k]
            assert 0 < len(want) < len(before)
        elif name == "simhash_near_dedup":
            label = test_simhash.plain_components([test_simhash.plain_fingerprint(r[1]) for r in before])
            want = [next(r for r, k in zip(before, label) if k == g) for g in dict.fromkeys(label)]
            assert len(want) < len(before)
        elif name == "benchmark_decontamination":
            bad = {r[0] for r in test_decontaminate.plain([r[:2] for r in before], benchmark) if r[5]}
            want = [r for r in before if r[0] not in bad]
            assert bad
        elif name == "personal_data":
            every = pii.all_spans([r[1] for r in before], test_pii.MODEL)
            want = [(i, t, s, len(t)) for (i, old, s, _), (_, spans) in zip(before, every) for t in [pii.masked(old, spans)]]
            assert want != before
        else:
            assert {r[:2] for r in got} <= {r[:2] for r in before}
            n = Counter(r[2] for r in before)
            rate = {r["source"]: r["rate"] for r in mixing.rates(spark.createDataFrame(before, "doc_id long, text string, source string, n_chars long")).collect()}
            assert all(abs(rate[s] * n[s] * len(n) / len(before) - 1) < 1e-9 for s in n)
            assert len(got) > 0.6 * len(before) and set(names) < set(docs.columns)
            LAST.extend(docs.collect())
            continue
        assert docs.columns == names and got == sorted(want), name


def test_run_gives_the_rows_of_its_stages(spark):
    got = sorted((r["doc_id"], r["text"], r["copy"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], r["text"], r["copy"]) for r in LAST)


def test_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
