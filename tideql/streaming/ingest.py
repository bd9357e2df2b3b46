"""Streams of samples: the guard against repeats and late ones, and appending to files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tideql.functions.shipping import ship


class NewestOnly(StatefulProcessor):
    """Lets a series' sample through if it is newer than all before it. State: the newest
    time of each series, forgotten a retention after its last sample arrived."""

    def __init__(self, retention: int | None):
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.retention is None else self.retention * 1000
        self.newest = handle.getValueState("newest", StructType([StructField("t", LongType())]), ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        whole = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        top = whole["t"].cummax().shift()
        if newest is not None:
            top = top.fillna(newest).clip(lower=newest)
        kept = whole[top.isna() | (whole["t"] > top)]
        if len(kept):
            self.newest.update((int(max(kept["t"].max(), newest or kept["t"].max())),))
            yield kept

    def close(self) -> None:
        pass


def guarded(stream: DataFrame, retention: int | None = None) -> DataFrame:
    """A stream of (metric, lkey, labels, t, v, arrival) less repeats and late samples: within
    a micro-batch by arrival, across them by state. labels go as JSON through Python."""
    ship(stream.sparkSession)
    flat = stream.select("metric", "lkey", F.to_json("labels").alias("labels"), "t", "v", "arrival")
    kept = flat.groupBy("metric", "lkey").transformWithStateInPandas(
        NewestOnly(retention), "metric string, lkey string, labels string, t bigint, v double, arrival bigint", "Append", "None" if retention is None else "ProcessingTime"
    )
    return kept.withColumn("labels", F.from_json("labels", "map<string,string>"))


def appended(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts to append a stream to Parquet by metric; every: the trigger's interval, or all
    that is there and stop. The checkpoint lets it go on where it was."""
    writer = stream.writeStream.format("parquet").partitionBy("metric").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def pruned(spark, path: str, now: int, retention: int) -> DataFrame:
    """The samples under path that the retention keeps: the prune is a job of its own, which
    does not depend on whether a collection went well."""
    return spark.read.parquet(path).where(F.col("t") >= now - retention)
