import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tideql.operators.series import accepted
from tideql.plans.compiler import Samples, instant
from tideql.sources.cluster import collected, unnamed
from tideql.sources.store import CorruptSnapshot, Store, restored, save
from tideql.streaming.ingest import appended, guarded

SHAPES = [
    [4.0] * 30,
    [536870912.0 + i * 4096 - (i % 7) * 8192 for i in range(30)],
    [i * 41237119 / 1e9 for i in range(30)],
    [(i % 250) / 1e3 for i in range(30)],
    [-0.0, 0.0, -0.0, 1.0, -0.0],
    [math.sqrt(i) * math.pi for i in range(30)],
    [1.0, math.nan, math.inf, -math.inf, 2.0],
    [1e300, -1e300, 1.7976931348623157e308, -1.7976931348623157e308],
    [7.5],
]
SCHEMA = "metric string, labels map<string,string>, t bigint, v double"


def test_snapshots_keep_every_bit_and_replace_one_another(spark, tmp_path):
    rows = [("m" if k % 2 else "a/b c", {"k": str(k), "é": "ß"}, 1_700_000_000 + 30 * i, v) for k, shape in enumerate(SHAPES) for i, v in enumerate(shape)]
    path = str(tmp_path / "held")
    first = save(spark.createDataFrame(rows, SCHEMA), path)
    bits = lambda v: struct.pack("<d", v) if not math.isnan(v) else "nan"
    got = sorted((r["metric"], sorted(r["labels"].items()), r["t"], bits(r["v"])) for r in Store(spark, path).rows.collect())
    assert got == sorted(((m, sorted(x.items()), t, bits(v)) for m, x, t, v in rows), key=lambda r: r[:3])
    second = save(spark.createDataFrame(rows[:30], SCHEMA), path)
    store = Store(spark, path)
    assert store.path == second != first and store.series().count() == 1
    plan = store.select(__import__("tideql.plans.language", fromlist=["x"]).parse("m"), 0, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan
    assert [p.name for p in (tmp_path / "held").iterdir() if "pointer" in p.name and not p.name.endswith(".crc")] == []
    assert Store(spark, path, now=1_700_000_000 + 30 * 29 + 60, retention=60).rows.count() == 1
    assert Store(spark, path, now=1_800_000_000, retention=60).series().count() == 0


def test_a_snapshot_that_cannot_be_read_gives_an_empty_store(spark, tmp_path):
    for text in (None, "", "{", '{"snapshot": "gone"}', '{"x": 1}'):
        path = tmp_path / "x"
        path.mkdir(exist_ok=True)
        if text is not None:
            (path / "current").write_text(text)
        with pytest.raises(CorruptSnapshot):
            Store(spark, str(path))
    assert instant(restored(spark, str(path), 0, 60), "sum({})", 5).count() == 0


NODES = {"items": [{"metadata": {"name": "n1"}, "status": {"capacity": {"cpu": "4", "memory": "2Gi", "odd": "x"}, "allocatable": {"cpu": "3500m"}}}, {"metadata": {"name": "n2"}, "status": {}}]}
PODS = {
    "items": [
        {
            "metadata": {"name": "p", "namespace": "ns"},
            "spec": {"nodeName": "n1", "containers": [{"name": "c", "image": "img:1", "resources": {"requests": {"cpu": "100m"}, "limits": {"memory": "1Ki"}}}, {"name": "d", "image": "img:d"}]},
            "status": {"containerStatuses": [{"name": "c", "image": "img@sha"}, {"name": "d", "image": ""}]},
        }
    ]
}
SUMMARY = {
    "node": {"cpu": {"usageCoreNanoSeconds": 2.5e9}, "memory": {"availableBytes": 10, "usageBytes": 5}, "fs": {"capacityBytes": 9}},
    "pods": [
        {
            "podRef": {"name": "p", "namespace": "ns"},
            "containers": [{"name": "c", "cpu": {"usageCoreNanoSeconds": 1e9}, "memory": {"workingSetBytes": 3, "usageBytes": 4}, "logs": {"usedBytes": 1}}, {"name": "d", "rootfs": {"usedBytes": 2}}, {"name": "new", "memory": {"usageBytes": 6}}],
            "network": {"rxBytes": 7},
            "volume": [{"usedBytes": 1, "capacityBytes": 2, "pvcRef": {"name": "claim", "namespace": "ns"}}, {"usedBytes": 5}],
        },
        {"podRef": {"name": "q", "namespace": "ns"}, "containers": [], "volume": [{"usedBytes": 99, "pvcRef": {"name": "claim", "namespace": "ns"}}]},
    ],
}


def test_cluster_documents(spark):
    text = lambda d: spark.createDataFrame([(json.dumps(d),)], "doc string")
    summaries = spark.createDataFrame([("n1", json.dumps(SUMMARY)), ("n2", None)], "node string, doc string")
    got = {(r["metric"], tuple(sorted(r["labels"].items()))): r["v"] for r in collected(text(NODES), text(PODS), summaries, 77).collect()}
    key = lambda m, **x: (m, tuple(sorted(x.items())))
    n1 = {"kubernetes_node": "n1", "instance": "n1", "node": "n1"}
    box = lambda c, image: {"namespace": "ns", "pod": "p", "container": c, "image": image, "instance": "n1"}
    own = {"namespace": "ns", "pod": "p", "container": "c", "node": "n1"}
    assert got == {
        key("kube_pod_container_resource_requests", **own, resource="cpu", unit="core"): 0.1,
        key("kube_pod_container_resource_limits", **own, resource="memory", unit="byte"): 1024,
        key("kube_node_status_capacity", node="n1", resource="cpu", unit="core"): 4,
        key("kube_node_status_capacity", node="n1", resource="memory", unit="byte"): 2 * 1024**3,
        key("kube_node_status_allocatable", node="n1", resource="cpu", unit="core"): 3.5,
        key("up", instance="n1", job="tideql"): 1,
        key("up", instance="n2", job="tideql"): 0,
        key("node_memory_MemTotal_bytes", **n1): 15,
        key("node_memory_MemFree_bytes", **n1): 10,
        key("node_memory_Buffers_bytes", **n1): 0,
        key("node_memory_Cached_bytes", **n1): 0,
        key("node_cpu_seconds_total", **n1, mode="user", cpu="0"): 2.5,
        key("node_filesystem_size_bytes", **n1, mountpoint="/"): 9,
        key("kubelet_running_pods", instance="n1"): 2,
        key("container_cpu_usage_seconds_total", **box("c", "img@sha")): 1,
        key("container_memory_working_set_bytes", **box("c", "img@sha")): 3,
        key("container_memory_working_set_bytes", **box("new", "unknown")): 6,
        key("container_fs_usage_bytes", **box("c", "img@sha")): 1,
        key("container_fs_usage_bytes", **box("d", "img:d")): 2,
        key("container_network_receive_bytes_total", namespace="ns", pod="p", instance="n1"): 7,
        key("kubelet_volume_stats_used_bytes", persistentvolumeclaim="claim", namespace="ns"): 1,
        key("kubelet_volume_stats_capacity_bytes", persistentvolumeclaim="claim", namespace="ns"): 2,
    }
    assert [tuple(r) for r in unnamed(text(PODS), summaries).collect()] == [("ns", "p", "new")]


def test_documents_that_are_none(spark):
    text = lambda d: spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),)], "doc string")
    wrong = ["<html>gateway error</html>", "", "[]", "3", "null", "{}", {"node": None}, {"node": 3}, {"node": {}, "pods": [{"containers": []}]}, {"node": {"fs": {"usedBytes": "x"}}}, {"node": {}, "pods": {}}, '{"node": {}']
    nodes = {"items": [{"metadata": {"name": f"n{i}"}} for i in range(len(wrong) + 1)]}
    answers = [(f"n{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate([*wrong, {"node": {}}])]
    rows = collected(text(nodes), text("{}"), spark.createDataFrame(answers, "node string, doc string"), 5).collect()
    assert sorted((r["metric"], r["labels"]["instance"], r["v"]) for r in rows) == sorted([("kubelet_running_pods", f"n{len(wrong)}", 0.0)] + [("up", f"n{i}", float(i == len(wrong))) for i in range(len(wrong) + 1)])
    for bad in ("<html>", {"items": [{}]}, {"items": [{"metadata": {"name": "p"}, "spec": {"containers": [{"image": "x"}]}}]}):
        assert collected(text("{}"), text(bad), spark.createDataFrame(answers[:0], "node string, doc string"), 5).count() == 0


def test_matchers_go_through_the_series(spark, tmp_path, monkeypatch):
    from tideql.plans.language import parse
    from tideql.sources import store

    rows = [(m, {"k": str(k)} | ({"x": "y"} if k % 2 else {}), t, float(k)) for m in ("a", "b") for k in range(30) for t in range(0, 50, 10) if not (m == "b" and k > 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    store.save(df, str(tmp_path / "s"))
    held, flat = store.Store(spark, str(tmp_path / "s")), Samples(df)
    for few in (1000, 2, 0):
        monkeypatch.setattr(store, "FEW_SERIES", few)
        for q in ('a{k="7"}', '{k=~"1.*"}', 'b{x!="y"}', '{k="25"}', 'a{k="none"}', '{__name__=~"a|b",x="y"}', "{}", "a"):
            one, two = (sorted((r["metric"], r["lkey"], r["t"], r["v"]) for r in s.select(parse(q), 10, 30).collect()) for s in (held, flat))
            assert one == two, (few, q)
    monkeypatch.setattr(store, "FEW_SERIES", 1000)
    plan = held.select(parse('a{k="7"}'), 10, 30)._jdf.queryExecution().executedPlan().toString()
    assert "lkey" in plan[plan.index("PushedFilters") :] and "PartitionFilters: [" in plan


def test_the_stream_guard_is_the_batch_guard(spark, tmp_path):
    rng = random.Random(4)
    rows = [("m", {"k": str(rng.randrange(4))}, rng.randrange(200) + i, float(i), i) for i in range(400)]
    df = Samples(spark.createDataFrame(rows, SCHEMA + ", arrival bigint")).rows
    want = sorted((r["lkey"], r["t"], r["v"]) for r in accepted(df).collect())
    for part in range(4):
        df.where(F.col("arrival").between(100 * part, 100 * part + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        appended(guarded(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted((r["lkey"], r["t"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and 0 < len(want) < 400
