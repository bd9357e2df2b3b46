"""Host-level quality rules with DataFrame functions only.

Rules are measured in each document's own row: no word leaves its row. Failures of each
rule are added up by host; a host's rate of each is shrunk by a beta prior fitted to all
hosts' rates of that rule by the method of moments; the verdict on the host, which fails
if its rate of any rule is too high, goes back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideql.llm.common import WHITE, table, written

LEAST_WORDS = 50
#: Percent of words in repeated windows above which a document fails.
MOST_REPEATED = 50
#: A host is rejected when its shrunk failure rate of a rule is above this.
MOST_FAILED = 0.5
#: The rules a document can fail: name, condition.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
#: Bits of a window's hash that are looked at; whatever their number, words are compared.
HASH_BITS = 64
#: Bounds on the prior's weight in documents.
PRIOR_WEIGHT = (1.0, 1000.0)


def _measured(docs: DataFrame, *carry: str) -> DataFrame:
    """docs(text, carry...) with n_words and the four measures.

    For repeated words each 3-word window becomes one long: bits of its 64-bit hash, then
    its place in as many bits as the text needs (15 for 20,000 words). Sorted, windows of
    equal hashes are neighbours; the words of those alone are sorted again and compared."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*carry, text.alias("t"))
    rows = rows.select(*carry, "t", F.filter(F.split("t", WHITE), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(*carry, "t", "w", "lines", F.size("w").alias("n"), F.expr(f"least({HASH_BITS}, 64 - int(ceil(log2(size(w) + 2))))").alias("high"))
    # window i of w, as hash bits above its place
    code = F.expr(
        "transform(if(n >= 3, sequence(0, n - 3), cast(array() as array<int>)), "
        "i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), 64 - high) | i)"
    )
    rows = rows.select(*carry, "t", "lines", "w", "n", "high", F.sort_array(code).alias("s"))
    # windows with a neighbour of an equal hash
    like = F.expr(
        "transform(filter(s, (x, j) -> "
        "(j > 0 and shiftright(s[j - 1], 64 - high) = shiftright(x, 64 - high)) or "
        "(j < size(s) - 1 and shiftright(s[j + 1], 64 - high) = shiftright(x, 64 - high))), "
        "x -> int(x & shiftrightunsigned(-1L, high)))"
    )
    rows = rows.select(*carry, "t", "lines", "w", "n", like.alias("p"))
    gram = F.expr("sort_array(transform(p, i -> named_struct('g', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i)))")
    rows = rows.select(*carry, "t", "lines", "w", "n", gram.alias("q"))
    # places of windows with an equal neighbour
    twin = F.expr("sort_array(transform(filter(q, (x, j) -> (j > 0 and q[j - 1].g = x.g) or (j < size(q) - 1 and q[j + 1].g = x.g)), x -> x.i))")
    rows = rows.select(*carry, "t", "lines", "w", "n", twin.alias("p"))
    covered = F.expr("aggregate(p, named_struct('end', 0, 'sum', 0L), (a, x) -> named_struct('end', x + 3, 'sum', a.sum + (x + 3 - greatest(a.end, x))), a -> a.sum)")
    return rows.select(
        *carry,
        F.col("n").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        covered.alias("n_repeat_words"),
    )


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    and whether each of RULES is broken) for each row."""
    rows = _measured(docs.select("doc_id", F.col(host).alias("host"), "text"), "doc_id", "host")
    rows = rows.select("*", *(F.expr(rule).alias(name) for name, rule in RULES.items()))
    return rows.withColumn("base_failed", F.col("few_words") | F.col("repeats")).drop("n_lines")


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, rate): the greatest of the posterior mean failure rates of a host's rules,
    each under a beta prior whose mean and weight are fitted to the hosts' own rates."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("bigint")).alias(r) for r in RULES))
    stats = []
    for r in RULES:
        share = F.col(r) / F.col("n")
        stats += [(F.sum(r) / F.sum("n")).alias(f"{r}_mean"), F.var_pop(share).alias(f"{r}_v")]
    of, rates = hosts.agg(F.avg(1 / F.col("n")).alias("inverse"), *stats).first(), []
    for r in RULES:
        mean = of[f"{r}_mean"] or 0.0
        # of the variance of observed rates, the part not due to sampling is the prior's
        noise = mean * (1 - mean) * (of["inverse"] or 0.0)
        spread = max((of[f"{r}_v"] or 0.0) - noise, 0.0)
        weight = min(max(mean * (1 - mean) / spread - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if spread > 0 else PRIOR_WEIGHT[1]
        rates.append((F.col(r) + mean * weight) / (F.col("n") + weight))
    return hosts.select("host", "n", F.greatest(*rates).alias("rate"))


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    host_rate, kept) for each row of docs(doc_id, text, host): a document is kept if it
    does not fail itself and its host's shrunk rate of no rule is above MOST_FAILED.

    Null texts have no words and fail. Rows without a host form a host of their own. Very
    long texts are measured whole; repeats are found by hash and settled by the words.
    Rows with a null doc_id and repeated rows each give a row. An empty table gives an
    empty result. Hosts are added up before the shuffle; rates go back to the small rows
    of measures, without texts, by a join that adaptive execution broadcasts while hosts
    are few and splits at a host with most of the rows otherwise."""
    rows = written(measured(docs, host), "measured")
    rates = host_rates(rows)
    back = rates.select(F.col("host").alias("host_"), F.col("rate").alias("host_rate"))
    return rows.join(back, rows["host"].eqNullSafe(back["host_"]), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= MOST_FAILED)).alias("kept")
    )


def query(spark, sf_dir):
    """Rule measures and verdicts of all documents, by source."""
    return judged(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
part AS (
  SELECT r, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM doc),
gram AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM part)),
twin AS (SELECT r, p FROM gram QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS p FROM twin) GROUP BY r),
measure AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM part LEFT JOIN covered USING (r)),
verdict AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3, 10 * n_dup_lines > 3 * n_lines AS f4,
    word_chars < 2 * n_words OR word_chars > 12 * n_words AS f5 FROM measure),
failure AS (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS failed FROM verdict),
host AS (SELECT source, rule, count(*) AS n, sum(failed::INTEGER) AS failed FROM failure GROUP BY source, rule),
moment AS (SELECT rule, sum(failed) / sum(n) AS mean, var_pop(failed / n) AS v, avg(1.0 / n) AS inverse FROM host GROUP BY rule),
spread AS (SELECT rule, mean, greatest(v - mean * (1 - mean) * inverse, 0) AS s FROM moment),
prior AS (SELECT rule, mean, CASE WHEN s > 0 THEN least(greatest(mean * (1 - mean) / s - 1, 1), 1000) ELSE 1000 END AS weight FROM spread),
rate AS (SELECT source, max((failed + mean * weight) / (n + weight)) AS rate FROM host JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, round(rate, 9) AS host_rate, NOT (f1 OR f2) AND rate <= 0.5 AS kept
FROM verdict JOIN rate ON verdict.source IS NOT DISTINCT FROM rate.source
"""
