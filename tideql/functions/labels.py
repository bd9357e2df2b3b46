"""Label maps: the canonical key, construction and matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideql.plans.language import NAME, Selector, jvm_regex


def label_key(labels: Column) -> Column:
    """One text for a label map whatever its entries' order: maps cannot be joined on."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\x01"), e["value"], F.lit("\x02"))), "")


def labels_of(key: Column) -> Column:
    """The label map of a canonical key: keys are texts, so they can be hashed and grouped
    by where maps cannot. No label holds the two control characters that part them."""
    return F.map_filter(F.str_to_map(key, F.lit("\x02"), F.lit("\x01")), lambda k, v: v.isNotNull())


def label_map(**values: Column | str) -> Column:
    """A label map without its null and empty values."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v.cast("string"))]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))


def matched(selector: Selector, metric: str = "metric", labels: str = "labels") -> Column:
    """The predicate of a selector. An absent label matches as the empty text; regular
    expressions hold for the whole value, a dot stands for all but a line feed, and classes
    of characters go beyond ASCII."""
    parts = [F.col(metric) == selector.name] if selector.name is not None else []
    for m in selector.matchers:
        value = F.col(metric) if m.label == NAME else F.coalesce(F.col(labels)[m.label], F.lit(""))
        if m.op in ("=", "!="):
            test = value == m.value
        else:
            test = value.rlike(rf"(?dU)\A(?:{jvm_regex(m.value)})\z")
        parts.append(test if m.op in ("=", "=~") else ~test)
    return reduce(Column.__and__, parts, F.lit(True))
