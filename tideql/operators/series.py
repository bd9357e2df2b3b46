"""Operators on series: as-of selection, rate, sum and matching, over a whole time grid.

Samples are rows (metric, lkey, labels, t, v) with ascending t in a series. Every operator
answers all points of a grid in one plan. Time is cut in chunks, and a sample also goes to
the next chunk as far as a point there may look back on it; the windows below are over a
chunk of a series, so that one long series is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideql.functions.labels import label_key, label_map, labels_of
from tideql.functions.numbers import ieee_divide

LOOKBACK = 300
#: Grid points in reach of one sample above which a rate takes running sums.
WIDE = 16
LEAST_CHUNK = 86_400


@dataclass(frozen=True)
class Grid:
    """Points start, start + step, ... up to end."""

    start: int
    end: int
    step: int = 1

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step


def _chunked(samples: DataFrame, reach: int, grid: Grid) -> tuple[DataFrame, int]:
    """Samples that points of the grid can look back on, with their chunk; reach: the
    seconds after its own that a sample counts in."""
    size = max(LEAST_CHUNK, 8 * (reach + 1))
    rows = samples.where((F.col("t") >= grid.start - reach) & (F.col("t") <= grid.end))
    own, far = F.floor((F.col("t") - grid.start) / size), F.floor((F.col("t") + reach - grid.start) / size)
    most = grid.last * grid.step // size
    chunks = F.filter(F.array_distinct(F.array(own, far)), lambda c: (c >= 0) & (c <= most))
    return rows.withColumn("chunk", F.explode(chunks)), size


def _points(low: Column, high: Column, grid: Grid, size: int) -> Column:
    """Numbers of the grid points in [low, high] within the row's chunk, as an array."""
    first = F.greatest(F.lit(0), low, grid.start + F.col("chunk") * size)
    last = F.least(high, grid.start + (F.col("chunk") + 1) * size - 1)
    a = F.greatest(F.lit(0), F.ceil((first - grid.start) / grid.step)).cast("bigint")
    b = F.least(F.lit(grid.last), F.floor((last - grid.start) / grid.step)).cast("bigint")
    return F.when(a <= b, F.sequence(a, b))


def _in_order(*more: str):
    return Window.partitionBy("metric", "lkey", "chunk", *more).orderBy("t")


def _series_key() -> Column:
    return F.concat(F.col("metric"), F.lit("\x02"), F.col("lkey"))


def as_of(samples: DataFrame, grid: Grid, lookback: int = LOOKBACK) -> DataFrame:
    """(labels, lkey, skey, t, v): at each grid point the newest sample of each series, not
    older than lookback. A sample answers the points from its own second to its successor's."""
    rows, size = _chunked(samples, lookback, grid)
    until = F.least(F.col("t") + lookback, F.coalesce(F.lead("t").over(_in_order()) - 1, F.col("t") + lookback))
    rows = rows.withColumn("until", until)
    return rows.select("labels", "lkey", _series_key().alias("skey"), F.explode(_points(F.col("t"), F.col("until"), grid, size)).alias("i"), "v").select(
        "labels", "lkey", "skey", (grid.start + F.col("i") * grid.step).cast("bigint").alias("t"), "v"
    )


def rate(samples: DataFrame, grid: Grid, seconds: int) -> DataFrame:
    """(labels, lkey, skey, t, v): the increase of each counter a second between the first
    and the last sample in (point - seconds, point]. A fall is a reset: the new value counts.
    Two samples at least; no extrapolation to the window's ends."""
    if seconds <= 0:
        return as_of(samples, grid).where(F.lit(False))
    rows, size = _chunked(samples, seconds - 1, grid)
    w = _in_order()
    before, gain = F.lag("v").over(w), F.col("v") - F.lag("v").over(w)
    # Spark holds NaN above all numbers; a fall from NaN is none
    rows = rows.withColumn("pt", F.lag("t").over(w)).withColumn("gain", F.when((F.col("v") < before) & ~F.isnan(before), F.col("v")).otherwise(gain))
    rows = rows.withColumn("skey", _series_key())
    return (_rate_wide if seconds > WIDE * grid.step else _rate_near)(rows, grid, seconds, size)


def _rate_near(rows: DataFrame, grid: Grid, seconds: int, size: int) -> DataFrame:
    """Each sample goes to all points that see it: one aggregate."""
    each = rows.select("skey", "t", "pt", "gain", F.explode(_points(F.col("t"), F.col("t") + seconds - 1, grid, size)).alias("i"))
    at = grid.start + F.col("i") * grid.step
    got = each.groupBy("skey", "i").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), F.sum(F.when(F.col("pt") > at - seconds, F.col("gain"))).alias("gain"))
    return _labelled(got.where((F.col("n") >= 2) & (F.col("span") > 0)), F.try_divide(F.col("gain"), F.col("span").cast("double")), grid)


def _labelled(rows: DataFrame, value: Column, grid: Grid) -> DataFrame:
    """(labels, lkey, skey, t, v) of rows by series key and grid point: texts group by hash, label maps would not."""
    rows = rows.select("skey", "i", value.alias("v")).withColumn("lkey", F.expr("substring(skey, instr(skey, '\x02') + 1)"))
    return rows.select(labels_of(F.col("lkey")).alias("labels"), "lkey", "skey", (grid.start + F.col("i") * grid.step).cast("bigint").alias("t"), "v")


def _rate_wide(rows: DataFrame, grid: Grid, seconds: int, size: int) -> DataFrame:
    """Where a window holds many points: running sums within a chunk, read at the window's
    last and first sample; two rows a point. Infinite and NaN gains are counted apart, so
    that they count in the windows that hold them only."""
    w = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    finite = F.col("gain").isNotNull() & ~F.isnan("gain") & (F.abs("gain") < float("inf"))
    sums = {"total": F.when(finite, F.col("gain")).otherwise(0.0), "nans": F.isnan("gain").cast("int"), "ups": (F.col("gain") == float("inf")).cast("int"), "downs": (F.col("gain") == -float("inf")).cast("int")}
    next_t = F.lead("t").over(_in_order())
    rows = rows.select("skey", "chunk", "t", "pt", next_t.alias("nt"), *(F.sum(F.coalesce(x, F.lit(0))).over(w).alias(k) for k, x in sums.items()))
    last = rows.select("skey", F.lit(True).alias("late"), "t", *sums, F.explode(_points(F.col("t"), F.least(F.coalesce(F.col("nt") - 1, F.lit(grid.end)), F.col("t") + seconds - 1), grid, size)).alias("i"))
    first = rows.select("skey", F.lit(False).alias("late"), "t", *sums, F.explode(_points(F.greatest(F.col("t"), F.coalesce(F.col("pt") + seconds, F.col("t"))), F.col("t") + seconds - 1, grid, size)).alias("i"))
    # of each kind a point and series have one row at most
    ends = [F.max(F.when(F.col("late") == F.lit(late), F.col(k))).alias(f"{k}_{n}") for k in ("t", *sums) for n, late in (("a", False), ("b", True))]
    got = last.union(first).groupBy("skey", "i").agg(*ends).where(F.col("t_b") > F.col("t_a"))
    more = {k: F.col(f"{k}_b") - F.col(f"{k}_a") for k in ("t", *sums)}
    up, down = more["ups"] > 0, more["downs"] > 0
    gain = F.when((more["nans"] > 0) | (up & down), F.lit(float("nan"))).when(up, F.lit(float("inf"))).when(down, F.lit(-float("inf"))).otherwise(more["total"])
    return _labelled(got, F.try_divide(gain, more["t"].cast("double")), grid)


def summed(vector: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row a point and group of the labels named; labels that are absent stay out of the
    group's. Nothing in, nothing out. Added up before the shuffle."""
    groups = [F.col("labels")[name].alias(f"by_{i}") for i, name in enumerate(by)]
    rows = vector.groupBy("t", *groups).agg(F.sum("v").alias("v"))
    rows = rows.select("t", "v", label_map(**{name: F.col(f"by_{i}") for i, name in enumerate(by)}).alias("labels")).withColumn("lkey", label_key(F.col("labels")))
    return rows.select("labels", "lkey", F.col("lkey").alias("skey"), "t", "v")


def applied(op: str, a: Column, b: Column) -> Column:
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: ieee_divide(a, b)}[op]()


def matched_pairs(op: str, left: DataFrame, right: DataFrame, right_unique: bool) -> DataFrame:
    """One-to-one on all labels at each point; what has no partner drops out. Of several
    right rows alike that of the greatest series key counts."""
    r = right.select("t", "lkey", "skey", "v") if right_unique else right.groupBy("t", "lkey").agg(F.max_by("v", "skey").alias("v"))
    r = r.select(F.col("t").alias("t_"), F.col("lkey").alias("lkey_"), F.col("v").alias("v_"))
    both = left.join(r, (F.col("t") == F.col("t_")) & (F.col("lkey") == F.col("lkey_")))
    return both.select("labels", "lkey", "skey", "t", applied(op, F.col("v"), F.col("v_")).alias("v"))


def accepted(samples: DataFrame, order: str = "arrival") -> DataFrame:
    """Samples in order of arrival that are newer than all before them in their series; repeats
    and late ones drop out. Keeps the columns."""
    w = Window.partitionBy("metric", "lkey").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.withColumn("__newest", F.max("t").over(w))
    return rows.where(F.col("__newest").isNull() | (F.col("t") > F.col("__newest"))).drop("__newest")


def retained(samples: DataFrame, now: int, seconds: int) -> DataFrame:
    """Samples not older than the retention."""
    return samples.where(F.col("t") >= now - seconds)


def series_of(samples: DataFrame) -> DataFrame:
    """(metric, lkey, labels, first_t, last_t, n) of every series."""
    return samples.groupBy("metric", "lkey").agg(F.first("labels").alias("labels"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))
