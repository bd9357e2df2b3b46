import math
import random

import pytest

from tests import model
from tideql.functions.numbers import divided, ieee_divide, quantity, unit_for, value_text
from tideql.operators import series as ops
from tideql.plans import api, discovery
from tideql.plans.compiler import Compiler, Samples, instant, over_range
from tideql.plans.language import NAME, parse
from tideql.plans.registry import oracle_sql, queries

FIRST, LAST = 1000, 1180
N3 = {"kubernetes_node": "node-a", "instance": "node-a", "node": "node-a"}
BOX = {"namespace": "app", "pod": "api-1", "container": "api", "image": "registry.example/api:1", "instance": "node-a"}
# metric, labels, base, increment
FIXTURE = [
    ("node_memory_MemTotal_bytes", N3, 2000, 0),
    ("node_memory_MemFree_bytes", N3, 500, 0),
    ("node_memory_Buffers_bytes", N3, 0, 0),
    ("node_memory_Cached_bytes", N3, 0, 0),
    ("node_cpu_seconds_total", N3 | {"mode": "user", "cpu": "0"}, 100, 15),
    ("node_filesystem_size_bytes", N3 | {"mountpoint": "/"}, 100, 0),
    ("node_filesystem_avail_bytes", N3 | {"mountpoint": "/"}, 40, 0),
    ("kubelet_running_pods", {"instance": "node-a"}, 12, 0),
    ("kube_node_status_capacity", {"node": "node-a", "resource": "memory", "unit": "byte"}, 2000, 0),
    ("kube_node_status_capacity", {"node": "node-a", "resource": "cpu", "unit": "core"}, 1, 0),
    ("kube_node_status_capacity", {"node": "node-a", "resource": "pods", "unit": "integer"}, 110, 0),
    ("kube_pod_container_resource_requests", {"namespace": "app", "pod": "api-1", "container": "api", "node": "node-a", "resource": "memory", "unit": "byte"}, 256, 0),
    ("container_cpu_usage_seconds_total", BOX, 10, 3),
    ("container_memory_working_set_bytes", BOX, 128, 0),
    ("container_network_receive_bytes_total", {"namespace": "app", "pod": "api-1", "instance": "node-a"}, 0, 300),
    ("kubelet_volume_stats_used_bytes", {"persistentvolumeclaim": "data", "namespace": "app"}, 42, 0),
]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, t bigint, v double")


@pytest.fixture(scope="module")
def store(spark):
    rows = [(m, x, FIRST + 30 * n, float(b + i * n)) for m, x, b, i in FIXTURE for n in range(7)]
    rows += [("reset_total", {"k": "a"}, 1000 + 30 * n, float(v)) for n, v in enumerate((100, 130, 5, 35))]
    rows += [("container_memory_working_set_bytes", BOX | {"pod": "api-10"}, LAST, 999.0)]
    s = Samples(rows_of(spark, rows))
    s.rows = s.rows.cache()
    return s


GOLDEN = [
    ("sum(node_memory_MemTotal_bytes - (node_memory_MemFree_bytes + node_memory_Buffers_bytes + node_memory_Cached_bytes)) by (kubernetes_name)", LAST, [({}, 1500)]),
    ('sum(rate(node_cpu_seconds_total{kubernetes_node=~"node-a", mode=~"user|system"}[1m]))', LAST, [({}, 0.5)]),
    ('sum({__name__=~"kubelet_running_pod_count|kubelet_running_pods", instance=~"node-a"})', LAST, [({}, 12)]),
    ('sum(kube_node_status_capacity{resource="memory"}) by (component)', LAST, [({}, 2000)]),
    ('sum(kube_node_status_capacity{resource="cpu"}) by (component)', LAST, [({}, 1)]),
    ('sum(node_filesystem_size_bytes{mountpoint=~"/|/local"} - node_filesystem_avail_bytes{mountpoint=~"/|/local"}) by (kubernetes_node)', LAST, [({"kubernetes_node": "node-a"}, 60)]),
    ('sum(rate(container_cpu_usage_seconds_total{pod=~"api-1"}[1m])) by (pod)', LAST, [({"pod": "api-1"}, 0.1)]),
    ('sum(container_memory_working_set_bytes{pod=~"api-1"}) by (pod)', LAST, [({"pod": "api-1"}, 128)]),
    ("sum(rate(container_network_receive_bytes_total[1m])) by (pod)", LAST, [({"pod": "api-1"}, 10)]),
    ("sum(kubelet_volume_stats_used_bytes) by (persistentvolumeclaim, namespace)", LAST, [({"persistentvolumeclaim": "data", "namespace": "app"}, 42)]),
    ('container_memory_working_set_bytes{image=""}', LAST, []),
    ("rate(reset_total[1m])", 1090, [({"k": "a"}, 1.0)]),
    ("rate(reset_total[2m])", 1090, [({"k": "a"}, 65 / 90)]),
    ("kubelet_running_pods", LAST + 600, []),
    ("sum(kubelet_running_pods) / 0", LAST, [({}, math.inf)]),
]


@pytest.mark.parametrize("query,at,want", GOLDEN)
def test_golden_answers(store, query, at, want):
    got = [(r["labels"], r["v"]) for r in instant(store, query, at).collect()]
    assert [x for x, _ in got] == [x for x, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want])


def test_scalars_and_range_defaults(store):
    assert instant(store, "1 + 2 * 3", LAST) == 7.0 and math.isnan(instant(store, "0 / 0", LAST)) and instant(store, "1 - 2 / 0", LAST) == -math.inf
    got = over_range(store, "kubelet_running_pods", FIRST, LAST, 60).collect()
    assert sorted((r["t"], r["v"]) for r in got) == [(FIRST + 60 * i, 12.0) for i in range(4)]
    assert over_range(store, "5", FIRST, LAST, 60).count() == 0 and instant(store, "sum(5)", LAST).count() == 0


def random_series(rng, nan=False):
    out = []
    for i in range(7):
        labels = {NAME: f"m{i % 3}", "a": rng.choice("xyz")} | ({"b": str(i)} if i % 2 else {}) | ({"c": "q"} if rng.random() < 0.5 else {})
        if any(labels == x for x, _ in out):
            continue
        t, samples = rng.randrange(500), []
        for _ in range(rng.randrange(2, 60)):
            t += rng.choice([1, 29, 30, 31, 90, 400, 3600])
            samples.append((t, rng.choice([math.nan, math.inf, -math.inf, -0.0]) if nan and rng.random() < 0.15 else float(rng.randrange(40))))
        out.append((labels, samples))
    return out


RANDOM = ["m0", "{}", '{a=~"x|y", c!="q"}', "rate(m1[2m])", "rate({}[1h])", 'irate({a!~"x"}[90s])', "sum(m0) by (a, c)", "sum(rate({}[5m])) by (b)", "m0 + m1 * 2", "1 / m2", "{} - {}", "m1 / (m1 - m1)", "sum(m0) - sum(m1)"]


@pytest.mark.parametrize("seed", range(3))
def test_plans_against_the_model(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(ops, "LEAST_CHUNK", 900)
    data = random_series(rng, nan=seed == 2)
    flat = [(x[NAME], {k: v for k, v in x.items() if k != NAME}, t, v) for x, s in data for t, v in s]
    held = Samples(rows_of(spark, flat))
    held.rows = held.rows.cache()
    for query in rng.sample(RANDOM, 6) + ["rate({}[1h])", "{}"]:
        for start, end, step in ((100, 6000, 61), (700, 30_000, 600)):
            got = sorted((tuple(sorted(r["labels"].items())), r["t"], r["v"]) for r in over_range(held, query, start, end, step).collect())
            assert model.same(got, model.over_range(data, query, start, end, step)), query


def test_division_is_that_of_floating_point(spark):
    xs = [1.0, 0.0, -0.0, -2.5, math.nan, math.inf, -math.inf, 7.0]
    pairs = [(a, b) for a in xs for b in xs]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a double, b double").select("a", "b", ieee_divide(F.col("a"), F.col("b")).alias("q"))
    for r in df.collect():
        want = model.ieee("/", r["a"], r["b"])
        for q in (r["q"], divided(r["a"], r["b"])):
            assert (math.isnan(q) and math.isnan(want)) or (q == want and math.copysign(1, q) == math.copysign(1, want)), (r, want)


def test_quantities_units_and_texts(spark):
    from pyspark.sql import functions as F

    want = {"1": 1, "100m": 0.1, "2Gi": 2147483648, "1990168Ki": 2037932032, "500M": 5e8, "110": 110, "": None, "1e3": 1000, "1E3": 1000, "1E": 1e18, " 5 ": 5, "1.5k": 1500, "abc": None, "1Zi": None, "1e": None, "5n": None, "5u": None}
    got = spark.createDataFrame([(k,) for k in want], "k string").select("k", quantity(F.col("k")).alias("v"), unit_for(F.col("k")).alias("u")).collect()
    assert {r["k"]: r["v"] for r in got} == want and all(r["u"] == "integer" for r in got)
    assert [value_text(v) for v in (1.0, -0.0, 1e14, 1e15, 0.1, 1e-7, math.nan, math.inf, -math.inf, 1.5e20)] == ["1", "0", "100000000000000", "1000000000000000", "0.1", "0.0000001", "NaN", "inf", "-inf", "150000000000000000000"]


def test_service(store):
    ok = lambda r: (r[0], r[1]["data"])
    assert ok(api.query(store, {"query": "kubelet_running_pods", "start": "1180.9"})) == (200, {"resultType": "vector", "result": [{"metric": {"instance": "node-a"}, "value": [1180, "12"]}]})
    assert ok(api.query(store, {"query": "1/4"}, now=7)) == (200, {"resultType": "scalar", "result": [7, "0.25"]})
    r = api.answer(store, "GET", "/api/v1/query_range?query=kubelet_running_pods&start=1000&end=1180&step=60")
    assert r[1]["data"]["result"] == [{"metric": {"instance": "node-a"}, "values": [[t, "12"] for t in (1000, 1060, 1120, 1180)]}]
    assert api.answer(store, "POST", "/api/v1/query?query=bad(", "query=1")[0] == 200
    for params in ({"query": "avg(x)"}, {"query": "x", "start": "5", "end": "4"}, {"query": "x", "start": "0", "end": "11001", "step": "1"}):
        status, body = api.query_range(store, params)
        assert status == 422 and body["errorType"] == "bad_data"
    assert api.query_range(store, {"query": "x", "start": "0", "end": "11000", "step": "1"})[0] == 200
    assert api.query_range(store, {"query": "kubelet_running_pods", "step": "1m"}, now=1180)[1]["data"]["result"][0]["values"] == [[t, "12"] for t in (1000, 1060, 1120, 1180)]
    names = api.answer(store, "GET", "/api/v1/labels")[1]["data"]
    assert names == sorted(names) and {NAME, "pod", "mountpoint"} <= set(names)
    assert api.answer(store, "GET", '/api/v1/label/pod/values?match[]=container_network_receive_bytes_total')[1]["data"] == ["api-1"]
    assert api.answer(store, "GET", "/api/v1/series")[0] == 422 and api.answer(store, "GET", "/api/v1/labels?match[]=sum(x)")[0] == 422
    assert api.answer(store, "GET", "/api/v1/series?match[]=(kubelet_running_pods)")[1]["data"] == [{NAME: "kubelet_running_pods", "instance": "node-a"}]
    assert api.answer(store, "GET", "/api/v1/series?match[]=kubelet_running_pods&start=1181")[1]["data"] == []
    assert api.answer(store, "GET", "/api/v1/metadata")[1]["data"] == {} and api.answer(store, "GET", "/health") == (200, "ok")
    assert api.answer(store, "GET", "/-/stats")[1] == {"series": 18, "samples": 117} and api.answer(store, "GET", "/nowhere")[0] == 404
    assert discovery.sets(store, ['{pod="api-1"}', '{namespace="app"}']).count() == 6


def test_plans_have_no_nested_loops_and_no_python(store):
    for query in ("sum(rate({}[1h])) by (pod)", "node_memory_MemTotal_bytes - node_memory_MemFree_bytes"):
        rows = over_range(store, query, FIRST, LAST, 30)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("NestedLoop", "Cartesian", "Python", "SortAggregate"))


def test_equal_parts_of_a_query_are_compiled_once(store):
    c = Compiler(store, ops.Grid(FIRST, LAST, 60))
    c(parse("kubelet_running_pods / kubelet_running_pods"))
    assert len(c.made) == 2


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())
