"""Samples from the tables of a directory: (metric, labels, lkey, t, v, arrival)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideql.functions.labels import label_key, label_map

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def seconds(column: str):
    """Whole seconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, {column})").cast("bigint")


def _sample(df: DataFrame, metric: str, labels, t, v, arrival=None) -> DataFrame:
    rows = df.select(F.lit(metric).alias("metric"), labels.alias("labels"), t.alias("t"), v.cast("double").alias("v"), (arrival if arrival is not None else F.lit(0).cast("bigint")).alias("arrival"))
    return rows.withColumn("lkey", label_key(F.col("labels")))


def event_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _sample(d, "event_value", label_map(event_type=F.col("event_type")), seconds("ts"), F.col("value"), F.col("event_id"))


def event_gauge_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users divisible by 5 have no event_type label, to have absent labels."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("user_id") % 5 != 0, F.col("event_type"))
    return _sample(d, "event_value_by_user", label_map(event_type=kind, user_id=F.col("user_id")), seconds("ts"), F.col("value"), F.col("event_id"))


def event_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("total", F.sum(F.col("value").cast("decimal(18,2)")).over(w))
    return _sample(d, "event_value_total", label_map(event_type=F.col("event_type")), seconds("ts"), F.col("total"), F.col("event_id"))


def event_reset_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _sample(d, "event_raw_total", label_map(event_type=F.col("event_type")), seconds("ts"), F.col("value"), F.col("event_id"))


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus", F.date_trunc("DAY", "l_shipdate").cast("timestamp_ntz").alias("day"))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    d = d.agg(F.sum(price).alias("gross"), F.sum(price * F.col("l_discount").cast("decimal(4,2)")).alias("discount"), F.count("*").alias("n"))
    labels, t = label_map(l_returnflag=F.col("l_returnflag"), l_linestatus=F.col("l_linestatus")), seconds("day")
    parts = [_sample(d, m, labels, t, F.col(c)) for m, c in (("ship_gross", "gross"), ("ship_discount", "discount"), ("ship_rows", "n"))]
    return parts[0].union(parts[1]).union(parts[2])


def order_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus", "o_orderpriority", F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("day"))
    d = d.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    return _sample(d, "order_total", label_map(o_orderstatus=F.col("o_orderstatus"), o_orderpriority=F.col("o_orderpriority")), seconds("day"), F.col("total"))
