"""Benchmark decontamination with DataFrame functions only.

Every benchmark text becomes windows of 13 consecutive words (fewer where the text
has fewer). A document is scanned in two steps. A window of n words that occurs in a
document holds the g = min(n, 5) words that begin at one of any n - g + 1 consecutive
places, so looking at every (n - g + 1)-th place is enough: its g words are hashed and
looked up in the set of hashes of all the windows' g-word parts. Only where that hits
are the n-word windows that begin within reach compared, word for word, with the
benchmark's. The sets are broadcast while the benchmark is small, which is checked;
beyond that the same joins shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideql.llm.common import BROADCAST_ROWS, table, written

WINDOW = 13
PROBE = 5
#: Characters of benchmark text up to which its windows are broadcast.
BROADCAST_CHARS = 4_000_000
#: A document is contaminated if it has a hit and at least one in so many of its words is hit.
SHARE = 20

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOW))


def words(text: Column) -> Column:
    """Words of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z."""
    return F.filter(F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows_of(benchmark: DataFrame) -> DataFrame:
    """(n, window, items, items_key): the distinct windows of all items, each with its items'
    ids in text order and the hash of them all."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    each = items.select("item", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"), "w")
    rows = each.groupBy("n", F.slice("w", F.col("at"), F.col("n")).alias("window")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.withColumn("items_key", F.xxhash64(F.size("items"), "items"))


def _hash(kind: int, array, start, length) -> Column:
    return F.xxhash64(F.lit(kind), F.slice(array, start, length))


def _parts(n: int) -> Column:
    """Hashes of all probe parts of a window of n words."""
    g = min(n, PROBE)
    return F.transform(F.sequence(F.lit(1), F.lit(n - g + 1)), lambda i: _hash(n, F.col("window"), i, F.lit(g)))


def _probes(n: int) -> Column:
    """The places of a document's words w to look at for windows of n words, each with
    the words of all windows that hold the part looked at."""
    g = min(n, PROBE)
    stride = n - g + 1
    places = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - g + 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))

    def probe(i):
        first = F.greatest(F.lit(1), i - stride + 1)
        return F.struct(F.lit(n).alias("n"), _hash(n, F.col("w"), i, F.lit(g)).alias("h"), first.alias("at"), F.slice(F.col("w"), first, i + n - first).alias("near"))

    return F.transform(places, probe)


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables. (doc_id, of_text, n_words, times, hits), a row for each kind of equal rows of
    docs(doc_id, text), of which there are `times`: hits is an array of (start, n, items_key),
    the places from 1 where a benchmark window occurs. And (items_key, items): the sets of
    items that share a window, each once, however many windows it shares."""
    windows = written(windows_of(benchmark), "windows")
    sets = windows.groupBy("items_key").agg(F.first("items").alias("items"))
    seen = windows.agg(F.collect_set("n").alias("ns"), F.sum(F.char_length(F.array_join("window", " "))).alias("chars")).first()
    lengths, small = sorted(seen["ns"]), (seen["chars"] or 0) <= BROADCAST_CHARS * WINDOW
    hint = F.broadcast if small else (lambda df: df)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("of_text"), words(F.col("text")).alias("w"))
    # every document sends a mark through, so that one pass over the texts gives documents and
    # candidates; marks are dealt by the document, not by one hash for all
    own = F.xxhash64("doc_id", "of_text")
    mark = F.array(F.struct(F.lit(0).alias("n"), own.alias("h"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("near")))
    probes = [_probes(n) for n in lengths]
    rows = keyed.select("doc_id", "of_text", F.size("w").alias("n_words"), F.explode(F.concat(mark, *probes)).alias("p"))
    rows = rows.select("doc_id", "of_text", "n_words", "p.n", "p.h", "p.at", "p.near")
    no_hit = F.lit(None).cast("struct<start:int,n:int,items_key:bigint>")
    if not lengths:
        found = rows.select("doc_id", "of_text", "n_words", "n", no_hit.alias("hit"))
    else:
        known = [windows.where(F.col("n") == n).select(F.explode(_parts(n)).alias("h")) for n in lengths]
        parts = reduce(DataFrame.union, known).distinct().withColumn("known", F.lit(True))
        near = rows.join(hint(parts), "h", "left").where(F.col("known") | (F.col("n") == 0))
        starts = F.sequence(F.lit(1), F.size("near") - F.col("n") + 1)
        cut = F.transform(starts, lambda i: F.struct((F.col("at") + i - 1).alias("start"), F.slice(F.col("near"), i, F.col("n")).alias("window")))
        none = F.array(F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("window")))
        each = near.select("doc_id", "of_text", "n_words", "n", F.explode(F.when((F.col("n") == 0), none).when(F.size("near") >= F.col("n"), cut)).alias("c"))
        each = each.select("doc_id", "of_text", "n_words", "n", "c.start", "c.window", F.when(F.col("n") == 0, own).otherwise(F.xxhash64("c.window")).alias("h"))
        exact = windows.select(F.col("n").alias("n_"), F.col("window").alias("window_"), "items_key", F.xxhash64("window").alias("h_"))
        found = each.join(hint(exact), (F.col("h") == F.col("h_")) & (F.col("n") == F.col("n_")) & (F.col("window") == F.col("window_")), "left").select(
            "doc_id", "of_text", "n_words", "n", F.when(F.col("items_key").isNotNull(), F.struct("start", "n", "items_key")).alias("hit")
        ).where(F.col("hit").isNotNull() | (F.col("n") == 0))
    got = found.groupBy("doc_id", "of_text").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("n") == 0).alias("times"), F.collect_set("hit").alias("hits"))
    return got, sets


def _covered(hits_column: Column) -> Column:
    """Words that lie in at least one hit."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, h):
        first = F.greatest(acc["end"] + 1, h["start"])
        last = h["start"] + h["n"] - 1
        return F.struct(F.greatest(acc["end"], last).alias("end"), (acc["n"] + F.greatest(F.lit(0), last - first + 1)).alias("n"))

    return F.aggregate(F.array_sort(hits_column), zero, step, lambda acc: acc["n"])


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each document.

    Null texts have no words and are not contaminated; nor are empty ones. Very long texts
    are scanned whole. Rows with a null doc_id count, repeated rows each give a row. Item
    ids that are null never show in items, though their windows hit. An empty benchmark
    hits nothing, an empty table of documents gives an empty result."""
    got, sets = hits(docs, benchmark)
    rows = written(got.select("doc_id", "of_text", F.col("n_words").cast("bigint").alias("n_words"), "times", _covered(F.col("hits")).alias("n_hit"), F.array_distinct(F.col("hits.items_key")).alias("keys")), "hits")
    names = ["doc_id", "of_text", "n_words", "times", "n_hit"]
    clean = rows.where("n_hit = 0").select(*names, F.array().cast("array<string>").alias("items"))
    hit = rows.where("n_hit > 0").select(*names, F.explode("keys").alias("items_key")).join(sets, "items_key")
    hit = hit.groupBy(*names).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    each = clean.union(hit).withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return each.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated. The contaminated ones' ids and
    hashes are written first: while they are few, the texts are not shuffled."""
    got, _ = hits(docs.select("doc_id", "text"), benchmark)
    bad = got.select("doc_id", "of_text", "n_words", _covered(F.col("hits")).alias("n_hit")).where((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
    bad = written(bad.select(F.col("doc_id").alias("__llm_id"), F.col("of_text").alias("__llm_text")), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__llm_id"]) & (F.xxhash64(docs["text"]) == bad["__llm_text"]), "left_anti")


def query(spark, sf_dir):
    """Contamination of all documents by all benchmark items."""
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
item AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos
        FROM (SELECT *, least(len(w), 13) AS n FROM item WHERE len(w) > 0))),
doc_window AS (
  SELECT r, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos
        FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)),
found AS (SELECT r, pos, d.n, item_id FROM doc_window d JOIN item_window i ON d.n = i.n AND d.win = i.win),
places AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS pos FROM found) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN places USING (r) LEFT JOIN ids USING (r)
"""
