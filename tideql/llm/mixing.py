"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideql.llm.common import partitions, table, written

SEED = 20
#: Mean of one Poisson draw at most; a greater mean is the sum of several draws.
PART = 32.0
#: Steps of the inverted distribution: beyond them a mean of PART leaves no probability that a double can tell from 0.
STEPS = 160
#: Sources up to which the table of rates is broadcast (STEPS + 5 numbers a source).
BROADCAST_SOURCES = 5_000


def _number(*parts: Column) -> Column:
    """The first 52 bits of the MD5 of the parts as text, colon-joined; a null part is empty."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, source: str = "source") -> DataFrame:
    """(source, n, rate, parts, cdf): for each source its rows, the mean number of copies of
    a row that brings the source to its share of epochs times all rows, the number of draws
    that make up that mean, and the distribution function of one draw. weights: by source,
    any positive scale; sources not named get none of the output; None: all sources alike."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        weighed = counts.withColumn("weight", weight)
    weighed = written(weighed, "counts")
    total = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    rate = F.lit(float(total["n"] or 0) * epochs) * F.col("weight") / F.lit(total["w"] or 1.0) / F.col("n")
    each = weighed.select("source", "n", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int")))
    mean = F.col("rate") / F.col("parts")
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    return each.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda acc: acc["cdf"]))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = SEED, source: str = "source") -> DataFrame:
    """All columns of docs, then copy (1, 2, ... of a row) and shuffle_key: each row as often
    as a Poisson draw says whose mean is its source's rate, in an order as good as random.

    A draw inverts the distribution at a number hashed from seed, doc_id and draw, so it is
    the same on every run and wherever the row lies. Rows alike in doc_id get the same draw.
    Rows without a source form a source of their own; null ids hash as the empty text; texts
    are not looked at. An empty table gives an empty result. The order is by a hashed key:
    rows go to partitions by it and are sorted by it within, so no source or group of copies
    stays together; the only broadcast is of at most BROADCAST_SOURCES rates, beyond which
    the join shuffles and adaptive execution splits a large source."""
    table_of = written(rates(docs, weights, epochs, source), "rates").select(F.col("source").alias("__llm_source"), F.col("parts").alias("__llm_parts"), F.col("cdf").alias("__llm_cdf"))
    if table_of.count() <= BROADCAST_SOURCES:
        table_of = F.broadcast(table_of)
    names = docs.columns
    rows = docs.join(table_of, docs[source].eqNullSafe(F.col("__llm_source")))
    rows = rows.select(*names, "__llm_cdf", F.explode(F.sequence(F.lit(1), F.col("__llm_parts"))).alias("__llm_part"))
    u = _number(F.lit(seed), docs["doc_id"], F.col("__llm_part")) / F.lit(float(1 << 52))
    rows = rows.withColumn("__llm_u", u).withColumn("__llm_k", F.size(F.filter("__llm_cdf", lambda c: c <= F.col("__llm_u"))))
    rows = rows.where(F.col("__llm_k") > 0).select(*names, "__llm_part", F.explode(F.sequence(F.lit(1), F.col("__llm_k"))).alias("__llm_j"))
    copy = ((F.col("__llm_part") - 1).cast("bigint") * 1000 + F.col("__llm_j")).alias("__llm_copy")
    rows = rows.select(*names, copy)
    key = _number(F.lit(seed), F.lit("order"), F.col("doc_id"), F.col("__llm_copy"))
    rows = rows.withColumn("__llm_key", key).repartition(partitions(docs.sparkSession), "__llm_key").sortWithinPartitions("__llm_key")
    return rows.withColumnsRenamed({"__llm_copy": _free("copy", names), "__llm_key": _free("shuffle_key", names)})


def _free(name: str, names: list[str]) -> str:
    while name.lower() in {n.lower() for n in names}:
        name = f"{name}_"
    return name


def query(spark, sf_dir):
    """All documents, mixed so that every source has the same expected share."""
    return mixed(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE source_rows AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rate AS (SELECT source, n, (SELECT sum(n) FROM source_rows)::DOUBLE * 1.0 / (SELECT sum(1.0::DOUBLE) FROM source_rows) / n AS rate FROM source_rows),
mean AS (SELECT source, greatest(1, ceil(rate / 32.0))::INTEGER AS parts, rate / greatest(1, ceil(rate / 32.0)) AS mean FROM rate),
cdf AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM mean
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 160),
draw AS (
  SELECT d.*, part, ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '') || ':' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN mean m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(1, parts + 1)) AS t(part)),
many AS (
  SELECT doc_id, text, lang, source, n_chars, part, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM draw.source AND c.c <= draw.u) AS k FROM draw),
copies AS (
  SELECT doc_id, text, lang, source, n_chars, (part - 1)::BIGINT * 1000 + j AS copy FROM many, unnest(range(1, k + 1)) AS t(j))
SELECT *, ('0x' || substr(md5('20:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT AS shuffle_key FROM copies
"""
