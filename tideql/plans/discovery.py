"""Label names, label values, label sets and counts of a store's series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideql.functions.labels import matched
from tideql.plans.language import NAME, BadQuery, Selector, parse


def selectors(texts: list[str]) -> list[Selector]:
    got = [parse(t) for t in texts]
    for t, tree in zip(texts, got):
        if not isinstance(tree, Selector):
            raise BadQuery(f"match[] must be a selector, found {t!r}")
    return got


def found(store, match: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of the series that any selector matches and whose samples overlap the window."""
    rows = store.series()
    chosen = selectors(list(match or ()))
    if chosen:
        rows = rows.where(reduce(Column.__or__, map(matched, chosen)))
    if start is not None:
        rows = rows.where(F.col("last_t") >= start)
    if end is not None:
        rows = rows.where(F.col("first_t") <= end)
    return rows


def names(store, match=None, start=None, end=None) -> DataFrame:
    """(name) of every label in use, the metric's own name among them."""
    rows = found(store, match, start, end)
    return rows.select(F.explode(F.concat(F.array(F.lit(NAME)), F.map_keys("labels"))).alias("name")).distinct().orderBy("name")


def values(store, name: str, match=None, start=None, end=None) -> DataFrame:
    """(value) of every value of a label."""
    rows = found(store, match, start, end)
    value = F.col("metric") if name == NAME else F.col("labels")[name]
    return rows.select(value.alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def sets(store, match: list[str], start=None, end=None) -> DataFrame:
    """(metric, labels) of every series; a selector at least is needed."""
    if not match:
        raise BadQuery("at least one match[] argument is required")
    return found(store, match, start, end).select("metric", "labels")


def stats(store) -> DataFrame:
    """One row: series and samples."""
    return store.series().agg(F.count("*").alias("series"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("samples"))
