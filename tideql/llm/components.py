"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideql.llm.common import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (a, b) of longs; root is the least
    node of its component. No component is gathered anywhere: each step joins
    edges with one least neighbour a node, which is aggregated before the shuffle.
    Ends when a step changes nothing; null ends and loops are ignored."""
    now = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        .distinct()
    )
    now, mark = written(now, "edges"), None
    for _ in range(max_rounds):
        at = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if at == mark or not at[0]:
            break
        mark = at
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = (
            large.join(low, "x")
            .select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
            .select("e.x", "e.y")
            .where(F.col("x") != F.col("y"))
            .distinct()
        )
        now = written(small, "edges")
    else:
        raise RuntimeError("components: no fixed point")
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).union(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
