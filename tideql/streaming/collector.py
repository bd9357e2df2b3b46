"""The collecting loop: a pass at every tick, a prune after it, snapshots now and then."""

from __future__ import annotations

import logging
import signal
import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideql.operators.series import series_of
from tideql.plans.compiler import Samples
from tideql.sources import poll, store
from tideql.sources.cluster import collected, unnamed

log = logging.getLogger(__name__)


class Tailed:
    """A store and the passes since it was written, less what the retention does not keep."""

    def __init__(self, base, tail: DataFrame | None, cutoff: int):
        names = ["metric", "lkey", "labels", "t", "v"]
        self.base, self.tail, self.cutoff = base, tail.select(*names) if tail is not None else None, cutoff
        rows = base.rows.select(*names)
        self.rows = (rows if tail is None else rows.unionByName(self.tail)).where(F.col("t") >= cutoff)

    def select(self, selector, low: int, high: int) -> DataFrame:
        low = max(low, self.cutoff)
        rows = self.base.select(selector, low, high).select("metric", "lkey", "labels", "t", "v")
        return rows if self.tail is None else rows.unionByName(Samples(self.tail).select(selector, low, high))

    def series(self) -> DataFrame:
        return series_of(self.rows)

    def last(self) -> DataFrame:
        """(metric, lkey, last) of every series: from the small table, and the passes since."""
        rows = self.base.series().select("metric", "lkey", F.col("last_t").alias("last"))
        if self.tail is not None:
            rows = rows.unionByName(self.tail.select("metric", "lkey", F.col("t").alias("last")))
        return rows.groupBy("metric", "lkey").agg(F.max("last").alias("last"))


class Collector:
    """Holds the samples as a snapshot and a tail: each tick appends one pass of documents, all
    at one second, less what is not newer than its series; what the retention does not keep
    is not seen from then on, whether or not the pass went well. Now and then, and at the
    end, all that is kept becomes a new snapshot; of old ones the last stays for its readers."""

    def __init__(self, spark: SparkSession, client, config: poll.Config, path: str, now: int | None = None):
        self.spark, self.client, self.config, self.path = spark, client, config, path
        self.pods, self.stopped = poll.Pods(config.pod_refresh_seconds), False
        self.snapshot_at = int(time.time()) if now is None else now
        self._on(store.restored(spark, path, self.snapshot_at, config.retention_seconds), self.snapshot_at)

    def _on(self, base, now: int) -> None:
        self.base, self.tail_path = base, f"{self.path}/tail-{uuid.uuid4().hex}"
        self.store = Tailed(base, None, now - self.config.retention_seconds)

    def tick(self, now: int):
        """One pass, and a snapshot if the last one is old enough."""
        try:
            nodes, pods, summaries = poll.documents(self.spark, self.client, self.pods, now)
            added = newer(self.store.last(), collected(nodes, pods, summaries, now))
            added.select("metric", "lkey", "labels", "t", "v").coalesce(1).write.mode("append").parquet(self.tail_path)
            if not unnamed(pods, summaries).isEmpty():
                self.pods.stale = True
        except (OSError, ValueError) as e:
            log.warning("collecting failed: %s", e)
        fs, Path = store._fs(self.spark, self.path)
        tail = self.spark.read.schema(store.SAMPLES).parquet(self.tail_path) if fs.exists(Path(self.tail_path)) else None
        self.store = Tailed(self.base, tail, now - self.config.retention_seconds)
        if now - self.snapshot_at >= self.config.snapshot_seconds:
            self.snapshot(now)
        return self.store

    def snapshot(self, now: int) -> None:
        """Writes all that is kept as the current snapshot. One that fails is told and tried
        again at a later tick; what is held stays."""
        try:
            before = getattr(self.base, "path", "")
            store.save(self.store.rows, self.path)
            self._on(store.Store(self.spark, self.path), now)
            store.swept(self.spark, self.path, before, self.base.path)
            self.snapshot_at = now
        except (OSError, ValueError, Py4JJavaError, PySparkException) as e:
            log.warning("snapshot failed: %s", e)

    def stop(self, *_) -> None:
        """Ends run() after the tick under way; fit to be a signal's handler."""
        self.stopped = True

    def run(self, ticks: int | None = None, clock=time.time, sleep=time.sleep):
        """Ticks at the interval; a tick that is late moves the ones after it. Ends with a
        snapshot, also on SIGTERM, where this is the main thread."""
        if threading.current_thread() is threading.main_thread():
            signal.signal(signal.SIGTERM, self.stop)
        n, began = 0, self.snapshot_at
        try:
            while not self.stopped and (ticks is None or n < ticks):
                began = clock()
                self.tick(int(began))
                n += 1
                sleep(max(0.0, self.config.scrape_seconds - (clock() - began)))
        finally:
            self.snapshot(int(began))
        return self.store


def newer(last: DataFrame, added: DataFrame) -> DataFrame:
    """Those rows of added that are newer than their series' last sample held."""
    return added.join(last, ["metric", "lkey"], "left").where(F.col("last").isNull() | (F.col("t") > F.col("last"))).drop("last")


def merged(parts: list[DataFrame]) -> Samples:
    """Samples of several sources in order of the list, by the same guard."""
    from tideql.operators.series import accepted

    rows = [p.select("metric", "lkey", "labels", "t", "v").withColumn("arrival", F.struct(F.lit(i).alias("part"), F.col("t").alias("at"))) for i, p in enumerate(parts)]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return Samples(accepted(whole).drop("arrival"))
