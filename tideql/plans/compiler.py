"""From a query's tree to one DataFrame plan over a whole time grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideql.functions.labels import matched
from tideql.functions.numbers import divided
from tideql.operators import series
from tideql.operators.series import Grid
from tideql.plans.language import Binary, Number, Rate, Selector, Sum, parse


@dataclass
class Scalar:
    value: float


@dataclass
class Vector:
    """rows: (labels, lkey, skey, t, v); unique: no two rows share t and lkey."""

    rows: DataFrame
    unique: bool


class Compiler:
    """store: anything with select(selector, low, high) giving samples."""

    def __init__(self, store, grid: Grid):
        self.store, self.grid, self.made = store, grid, {}

    def __call__(self, tree) -> Scalar | Vector:
        if tree not in self.made:
            self.made[tree] = self._compiled(tree)
        return self.made[tree]

    def _empty(self) -> DataFrame:
        return series.as_of(self.store.select(Selector(), 0, 0), self.grid).where(F.lit(False))

    def vector(self, tree) -> Vector:
        """A number where a vector is needed is the empty vector."""
        got = self(tree)
        return got if isinstance(got, Vector) else Vector(self._empty(), True)

    def _compiled(self, tree):
        g = self.grid
        if isinstance(tree, Number):
            return Scalar(tree.value)
        if isinstance(tree, Selector):
            rows = self.store.select(tree, g.start - series.LOOKBACK, g.end)
            return Vector(series.as_of(rows, g), tree.name is not None)
        if isinstance(tree, Rate):
            rows = self.store.select(tree.of, g.start - tree.seconds + 1, g.end)
            return Vector(series.rate(rows, g, tree.seconds), tree.of.name is not None)
        if isinstance(tree, Sum):
            return Vector(series.summed(self.vector(tree.of).rows, tree.by), True)
        assert isinstance(tree, Binary)
        a, b, op = self(tree.left), self(tree.right), tree.op
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            x, y = a.value, b.value
            return Scalar(divided(x, y) if op == "/" else x + y if op == "+" else x - y if op == "-" else x * y)
        if isinstance(b, Scalar):
            return Vector(a.rows.withColumn("v", series.applied(op, F.col("v"), F.lit(b.value))), a.unique)
        if isinstance(a, Scalar):
            return Vector(b.rows.withColumn("v", series.applied(op, F.lit(a.value), F.col("v"))), b.unique)
        return Vector(series.matched_pairs(op, a.rows, b.rows, b.unique), a.unique)


def instant(store, query: str, at: int) -> float | DataFrame:
    """A number, or (labels, lkey, t, v) at one time; values that are not finite stay."""
    got = Compiler(store, Grid(at, at))(parse(query))
    return got.value if isinstance(got, Scalar) else got.rows.select("labels", "lkey", "t", "v")


def over_range(store, query: str, start: int, end: int, step: int) -> DataFrame:
    """(labels, lkey, t, v) at every point of the grid, without values that are not finite;
    of a number nothing."""
    rows = Compiler(store, Grid(start, end, max(1, step))).vector(parse(query)).rows
    return rows.where(~F.isnan("v") & (F.abs("v") < float("inf"))).select("labels", "lkey", "t", "v")


class Samples:
    """A store over one flat DataFrame (metric, labels, t, v); lkey is made if absent."""

    def __init__(self, rows: DataFrame):
        from tideql.functions.labels import label_key

        self.rows = rows if "lkey" in rows.columns else rows.withColumn("lkey", label_key(F.col("labels")))

    def select(self, selector: Selector, low: int, high: int) -> DataFrame:
        return self.rows.where(matched(selector) & (F.col("t") >= low) & (F.col("t") <= high))

    def series(self) -> DataFrame:
        return series.series_of(self.rows)
