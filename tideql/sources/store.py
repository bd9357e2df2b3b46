"""Series on disk: samples by metric in time order, a small table of series, snapshots.

A snapshot is a new directory, complete before one pointer file names it; a reader sees
the old one or the new one. Readers go by the pointer, so a job that dies half-way leaves
the last snapshot as it was.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideql.functions.labels import label_key, matched
from tideql.operators.series import retained, series_of
from tideql.plans.language import Selector

#: Series up to which a selector's keys go into the scan as a list.
FEW_SERIES = 1000
SAMPLES = "metric string, lkey string, labels map<string,string>, t bigint, v double"


class CorruptSnapshot(ValueError):
    """The pointer or what it names cannot be read."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Unset: a
    new temporary folder, in local mode only."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tideql-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def save(samples: DataFrame, path: str) -> str:
    """Writes samples (metric, labels, t, v) as a snapshot under path; gives its directory.
    Rows go to files by metric and series, in time order within, so that a name prunes
    directories and a series few row groups; a large series is split by adaptive execution."""
    spark = samples.sparkSession
    rows = samples if "lkey" in samples.columns else samples.withColumn("lkey", label_key(F.col("labels")))
    name = f"snapshot-{uuid.uuid4().hex}"
    rows = rows.select("lkey", "labels", "t", "v", "metric")
    rows.hint("rebalance", "metric", "lkey").sortWithinPartitions("metric", "lkey", "t").write.partitionBy("metric").parquet(f"{path}/{name}/samples")
    back = spark.read.schema(SAMPLES).parquet(f"{path}/{name}/samples")
    series_of(back).write.parquet(f"{path}/{name}/series")
    fs, Path = _fs(spark, path)
    held = Path(f"{path}/.pointer-{uuid.uuid4().hex}")
    out = fs.create(held, True)
    out.write(bytearray(json.dumps({"snapshot": name, "version": 1}).encode()))
    out.close()
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri().resolve("."), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(held), fs.makeQualified(Path(f"{path}/current")), _overwrite(spark)
    )
    return f"{path}/{name}"


def swept(spark: SparkSession, path: str, *keep: str) -> None:
    """Deletes the snapshots and tails under path but those kept, by their directories."""
    fs, Path = _fs(spark, path)
    names = {k.rstrip("/").rsplit("/", 1)[-1] for k in keep}
    for status in fs.listStatus(Path(path)):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(("snapshot-", "tail-")) and name not in names:
            fs.delete(status.getPath(), True)


def _overwrite(spark: SparkSession):
    kind = spark.sparkContext._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    chosen = next(o for o in kind.getEnumConstants() if o.name() == "OVERWRITE")
    made = spark.sparkContext._jvm.java.lang.reflect.Array.newInstance(kind, 1)
    spark.sparkContext._jvm.java.lang.reflect.Array.set(made, 0, chosen)
    return made


class Store:
    """The current snapshot under a path, less what is older than the retention at `now`."""

    def __init__(self, spark: SparkSession, path: str, now: int | None = None, retention: int | None = None):
        fs, Path = _fs(spark, path)
        try:
            text = "\n".join(r[0] for r in spark.read.text(f"{path}/current").collect())
            name = json.loads(text)["snapshot"]
            if not fs.exists(Path(f"{path}/{name}/series/_SUCCESS")):
                raise CorruptSnapshot(f"{name} is not complete")
        except CorruptSnapshot:
            raise
        except Exception as e:
            raise CorruptSnapshot(f"no snapshot can be read at {path}") from e
        self.cutoff = None if now is None or retention is None else now - retention
        self.path, self._series = f"{path}/{name}", spark.read.parquet(f"{path}/{name}/series")
        self.rows = spark.read.schema(SAMPLES).parquet(f"{path}/{name}/samples")
        if self.cutoff is not None:
            self.rows = retained(self.rows, now, retention)

    def select(self, selector: Selector, low: int, high: int) -> DataFrame:
        """The metric prunes directories, t row groups. Label matchers hold on the small table of
        series; the keys it gives prune row groups while they are few, or else join."""
        rows = self.rows.where((F.col("t") >= low) & (F.col("t") <= high))
        if not selector.matchers:
            return rows.where(matched(selector))
        keys = self._series.where(matched(selector) & (F.col("last_t") >= low) & (F.col("first_t") <= high)).select("metric", "lkey")
        few = keys.limit(FEW_SERIES + 1).collect()
        if len(few) <= FEW_SERIES:
            metrics, each = sorted({r["metric"] for r in few}), sorted({r["lkey"] for r in few})
            # a key that another metric has too is told apart by the exact pairs
            rows = rows.where(F.col("metric").isin(metrics) & F.col("lkey").isin(each))
            return rows if len(few) == len(metrics) * len(each) else rows.join(F.broadcast(keys), ["metric", "lkey"], "left_semi").select(*self.rows.columns)
        if selector.name is not None:
            rows = rows.where(F.col("metric") == selector.name)
        return rows.join(keys, ["metric", "lkey"], "left_semi").select(*self.rows.columns)

    def series(self) -> DataFrame:
        """From the small table; counts and first times from the samples where a cutoff cuts."""
        return self._series if self.cutoff is None else series_of(self.rows)


def restored(spark: SparkSession, path: str, now: int, retention: int):
    """The snapshot's store, or an empty one if none can be read."""
    from tideql.plans.compiler import Samples

    try:
        return Store(spark, path, now, retention)
    except CorruptSnapshot:
        return Samples(spark.createDataFrame([], SAMPLES))
