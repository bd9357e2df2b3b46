"""Cluster documents (nodes, pods, node summaries) to samples, as projections and explodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideql.functions.labels import label_key, label_map
from tideql.functions.numbers import quantity, unit_for

UNKNOWN_IMAGE = "unknown"
JOB = "tideql"

# fixed values: the documents' fields that are read
_META = "metadata struct<name:string,namespace:string>"
NODES = f"items array<struct<{_META.replace(' ', ':', 1)},status:struct<capacity:map<string,string>,allocatable:map<string,string>>>>"
PODS = (
    f"items array<struct<{_META.replace(' ', ':', 1)},"
    "spec:struct<nodeName:string,containers:array<struct<name:string,image:string,resources:struct<requests:map<string,string>,limits:map<string,string>>>>>,"
    "status:struct<containerStatuses:array<struct<name:string,image:string>>>>>"
)
_USE = "cpu:struct<usageCoreNanoSeconds:double>,memory:struct<availableBytes:double,workingSetBytes:double,usageBytes:double>"
_VOLUME = "struct<usedBytes:double,capacityBytes:double,pvcRef:struct<name:string,namespace:string>>"
SUMMARY = (
    f"node struct<{_USE},fs:struct<capacityBytes:double,availableBytes:double,usedBytes:double>>,"
    f"pods array<struct<podRef:struct<name:string,namespace:string>,containers:array<struct<name:string,{_USE},rootfs:struct<usedBytes:double>,logs:struct<usedBytes:double>>>,"
    f"network:struct<rxBytes:double,txBytes:double>,volume:array<{_VOLUME}>>>"
)


def _any(items: str, test: str) -> str:
    return f"exists(coalesce({items}, array()), x -> {test})"


# fixed values: the fields that a document of each kind must have; what it lacks may be told by nulls else
_LACKS = {
    NODES: _any("doc.items", "x.metadata is null"),
    PODS: " or ".join([_any("doc.items", "x.metadata is null"), _any("flatten(doc.items.spec.containers)", "x.name is null"), _any("flatten(doc.items.status.containerStatuses)", "x.name is null")]),
    SUMMARY: f"doc.node is null or {_any('doc.pods', 'x.podRef is null')}",
}


def decoded(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the document in the text column doc read by a schema, in place. A text that
    is no JSON, has a field of another kind, or lacks a field it must have, gives null."""
    names = [n for n in rows.columns if n != "doc"]
    got = rows.select(*names, F.from_json("doc", f"{schema}, wrong string", {"columnNameOfCorruptRecord": "wrong"}).alias("doc"))
    bad = F.expr(f"doc is null or doc.wrong is not null or coalesce({_LACKS[schema]}, false)")
    return got.withColumn("doc", F.when(~bad, F.col("doc").dropFields("wrong")))


def _samples(rows: DataFrame, place: Column, *made: tuple[str, dict, Column]) -> DataFrame:
    """(place, metric, labels, v) of each made (metric, labels, value) of each row, without null values."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), label_map(**labels).alias("labels"), v.cast("double").alias("v")) for m, labels, v in made))
    return rows.select(place.alias("place"), F.posexplode(each).alias("at", "s")).select(F.struct("place", "at").alias("place"), "s.metric", "s.labels", "s.v").where(F.col("v").isNotNull())


def _quantities(rows: DataFrame, place: Column, metric: str, of: Column, **labels) -> DataFrame:
    each = rows.select(place.alias("place"), *(c.alias(f"l_{k}") for k, c in labels.items()), F.explode(of).alias("resource", "text"))
    named = {k: F.col(f"l_{k}") for k in labels} | {"resource": F.col("resource"), "unit": unit_for(F.col("resource"))}
    rows = each.select(F.struct(F.struct("place", "resource").alias("place"), F.lit(0).alias("at")).alias("place"), F.lit(metric).alias("metric"), label_map(**named).alias("labels"), quantity(F.col("text")).alias("v"))
    return rows.where(F.col("v").isNotNull())


def _image(image: Column) -> Column:
    return F.coalesce(F.when(image != "", image), F.lit(UNKNOWN_IMAGE))


def images(pods: DataFrame) -> DataFrame:
    """(namespace, pod, container, image): the image that a container reports, else the one it asks for."""
    pod = pods.select(F.explode("doc.items").alias("p"))
    at = [F.coalesce("p.metadata.namespace", F.lit("")).alias("namespace"), F.coalesce("p.metadata.name", F.lit("")).alias("pod")]
    asked = pod.select(*at, F.explode("p.spec.containers").alias("c"), F.lit(0).alias("rank"))
    told = pod.select(*at, F.explode("p.status.containerStatuses").alias("c"), F.lit(1).alias("rank"))
    rows = asked.select("namespace", "pod", "c.name", "c.image", "rank").union(told.select("namespace", "pod", "c.name", "c.image", "rank").where("image <> ''"))
    return rows.groupBy("namespace", "pod", F.col("name").alias("container")).agg(F.max_by("image", "rank").alias("image"))


def collected(nodes: DataFrame, pods: DataFrame, summaries: DataFrame, t: int, job: str = JOB) -> DataFrame:
    """(metric, labels, lkey, t, v): the samples of one pass, all at the second t.

    nodes(doc), pods(doc): node and pod lists as text; summaries(node, doc): each node's
    summary, null where the node did not answer. That, or an answer that is no summary, gives
    the node `up` 0 and nothing else.
    Of samples alike in metric and labels the first of the documents counts."""
    nodes, pods, summaries = decoded(nodes, NODES), decoded(pods, PODS), decoded(summaries, SUMMARY)
    parts = []
    pod = pods.select(F.posexplode("doc.items").alias("i", "p")).select("i", "p.*")
    box = pod.select("i", "metadata", "spec.nodeName", F.posexplode("spec.containers").alias("j", "c"))
    own = {"namespace": F.col("metadata.namespace"), "pod": F.col("metadata.name"), "container": F.col("c.name"), "node": F.col("nodeName")}
    for n, what in enumerate(("requests", "limits")):
        parts.append(_quantities(box, F.format_string("%d/%08d/%08d", F.lit(n), "i", "j"), f"kube_pod_container_resource_{what}", F.col(f"c.resources.{what}"), **own))
    node = nodes.select(F.posexplode("doc.items").alias("i", "n")).select("i", F.col("n.metadata.name").alias("name"), "n.status")
    for what in ("capacity", "allocatable"):
        parts.append(_quantities(node, F.format_string("%08d", "i"), f"kube_node_status_{what}", F.col(f"status.{what}"), node=F.col("name")))
    answers = node.select("i", "name").join(summaries.select(F.col("node").alias("name"), "doc"), "name", "left")
    flat = lambda place: F.struct(place.alias("place"), F.lit("").alias("resource"))
    order = F.format_string("%08d", "i")
    parts.append(_samples(answers, flat(order), ("up", {"instance": F.col("name"), "job": job}, F.when(F.col("doc").isNotNull(), 1.0).otherwise(0.0))))
    live = answers.where(F.col("doc").isNotNull()).select("i", "name", "doc.node", F.coalesce("doc.pods", F.array().cast(summaries.schema["doc"].dataType["pods"].dataType)).alias("pods"))
    three = {"kubernetes_node": F.col("name"), "instance": F.col("name"), "node": F.col("name")}
    memory, fs = F.col("node.memory"), F.col("node.fs")
    free = F.when(memory.isNotNull(), F.coalesce(memory["availableBytes"], F.lit(0.0)))
    used = F.coalesce(memory["workingSetBytes"], memory["usageBytes"], F.lit(0.0))
    none = F.when(memory.isNotNull(), F.lit(0.0))
    parts.append(
        _samples(
            live,
            flat(order),
            ("node_memory_MemTotal_bytes", three, free + used),
            ("node_memory_MemFree_bytes", three, free),
            ("node_memory_Buffers_bytes", three, none),
            ("node_memory_Cached_bytes", three, none),
            ("node_cpu_seconds_total", three | {"mode": "user", "cpu": "0"}, F.col("node.cpu.usageCoreNanoSeconds") / 1e9),
            ("node_filesystem_size_bytes", three | {"mountpoint": "/"}, fs["capacityBytes"]),
            ("node_filesystem_avail_bytes", three | {"mountpoint": "/"}, fs["availableBytes"]),
            ("kubelet_running_pods", {"instance": F.col("name")}, F.size("pods").cast("double")),
        )
    )
    seen = live.select("i", "name", F.posexplode("pods").alias("j", "p")).select("i", "j", "name", F.col("p.podRef.namespace").alias("ns"), F.col("p.podRef.name").alias("pod"), "p.*")
    deep = F.format_string("%08d/%08d", "i", "j")
    net = {"namespace": F.col("ns"), "pod": F.col("pod"), "instance": F.col("name")}
    parts.append(_samples(seen, flat(deep), ("container_network_receive_bytes_total", net, F.col("network.rxBytes")), ("container_network_transmit_bytes_total", net, F.col("network.txBytes"))))
    volume = seen.select("i", "j", F.posexplode("volume").alias("k", "v")).where("v.pvcRef is not null")
    claim = {"persistentvolumeclaim": F.col("v.pvcRef.name"), "namespace": F.col("v.pvcRef.namespace")}
    deeper = F.format_string("%08d/%08d/%08d", "i", "j", "k")
    parts.append(_samples(volume, flat(deeper), ("kubelet_volume_stats_used_bytes", claim, F.col("v.usedBytes")), ("kubelet_volume_stats_capacity_bytes", claim, F.col("v.capacityBytes"))))
    known = images(pods).select(F.col("namespace").alias("ns_"), F.col("pod").alias("pod_"), F.col("container").alias("c_"), "image")
    run = seen.select("i", "j", "name", "ns", "pod", F.posexplode("containers").alias("k", "c"))
    same = F.col("ns").eqNullSafe(F.col("ns_")) & F.col("pod").eqNullSafe(F.col("pod_")) & F.col("c.name").eqNullSafe(F.col("c_"))
    run = run.join(known, same, "left")
    box = {"namespace": F.col("ns"), "pod": F.col("pod"), "container": F.col("c.name"), "image": _image(F.col("image")), "instance": F.col("name")}
    root, logs = F.col("c.rootfs.usedBytes"), F.col("c.logs.usedBytes")
    disk = F.when(root.isNotNull() | logs.isNotNull(), F.coalesce(root, F.lit(0.0)) + F.coalesce(logs, F.lit(0.0)))
    parts.append(
        _samples(
            run,
            flat(deeper),
            ("container_cpu_usage_seconds_total", box, F.col("c.cpu.usageCoreNanoSeconds") / 1e9),
            ("container_memory_working_set_bytes", box, F.coalesce("c.memory.workingSetBytes", "c.memory.usageBytes")),
            ("container_fs_usage_bytes", box, disk),
        )
    )
    rows = reduce(DataFrame.unionByName, parts).withColumn("lkey", label_key(F.col("labels")))
    first = rows.groupBy("metric", "lkey").agg(F.min_by(F.struct("labels", "v"), "place").alias("s"))
    return first.select("metric", "s.labels", "lkey", F.lit(t).cast("bigint").alias("t"), "s.v")


def unnamed(pods: DataFrame, summaries: DataFrame) -> DataFrame:
    """(namespace, pod, container) that run but whose image the pod list does not tell: a
    sign that the list held is out of date."""
    known = images(decoded(pods, PODS)).where("image <> ''")
    seen = decoded(summaries, SUMMARY).select(F.explode("doc.pods").alias("p")).select("p.podRef", F.explode("p.containers").alias("c"))
    seen = seen.select(F.col("podRef.namespace").alias("namespace"), F.col("podRef.name").alias("pod"), F.col("c.name").alias("container"))
    return seen.join(known, ["namespace", "pod", "container"], "left_anti")
