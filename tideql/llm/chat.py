"""Chat formatting: cumulative snapshots collapse to maximal conversations, then render.

DataFrame functions only. Logs often hold a conversation again and again, each time a
few turns longer. A rolling hash over the turns gives every prefix one key; an anti-join
drops conversations whose whole key is the key of a longer one's prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideql.llm.common import table, written

#: One turn of the rendered text.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def _turn_hash(salt: int, place: Column, turn: Column) -> list[Column]:
    """A hash of a turn and its place, as two numbers of 32 bits. Hashes pass nulls over, so
    whether there is one goes in."""
    h = F.xxhash64(F.lit(salt), place, turn["role"].isNull(), turn["role"], turn["text"].isNull(), turn["text"])
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1))]


def prefixes(each: DataFrame) -> DataFrame:
    """(conv_id, place, key) of every prefix of each(conv_id, turns): the key is the number of
    turns and the running sums of two 64-bit hashes of turns at their places, each as two
    halves, so that no sum overflows. One pass over the turns, however many."""
    rows = each.select("conv_id", F.posexplode("turns").alias("place", "turn"))
    parts = [h.alias(f"h{2 * salt + i}") for salt in (0, 1) for i, h in enumerate(_turn_hash(salt, F.col("place"), F.col("turn")))]
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "place", *parts)
    return rows.select("conv_id", "place", F.struct("place", *(F.sum(f"h{i}").over(so_far).alias(f"s{i}") for i in range(4))).alias("key"))


def collapsed(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns): the conversations of turns(conv_id, turn, role, text) that
    are not the beginning of a longer one; of equal ones that with the least id.

    Turns are ordered by turn (nulls first), then role and text; a turn that is repeated
    in all of these counts once. Turns with a null conv_id form one conversation. A
    conversation is one row of the result, so one has to fit in memory; the work on it is
    linear in its turns, but for their sort. Null and empty texts are different turns. A
    common first turn is one key among distinct keys, so it makes no large group. An empty
    table gives an empty result."""
    each = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    each = written(each.select("conv_id", "turns", F.size("turns").alias("n_turns")), "conversations")
    keys = written(prefixes(each).withColumn("whole", F.lead("place").over(Window.partitionBy("conv_id").orderBy("place")).isNull()), "prefixes")
    whole = keys.where("whole").groupBy("key").agg(F.min(F.struct("conv_id")).alias("c")).select("key", "c.conv_id")
    shorter = keys.where("not whole").select("key").distinct()
    kept = whole.join(shorter, "key", "left_anti").select(F.col("conv_id").alias("kept_id"))
    return each.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi").select("conv_id", "n_turns", "turns")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text) of the collapsed conversations; each turn is its role's
    mark, its text and an end mark. A null role renders as unknown, a null text as empty."""
    def one(t):
        head, tail = OPEN.split("{role}")
        return F.concat(F.lit(head), F.coalesce(t["role"], F.lit("unknown")), F.lit(tail), F.coalesce(t["text"], F.lit("")), F.lit("\n" + CLOSE))

    return collapsed(turns).select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.array_join(F.transform("turns", one), "").alias("text"))


def query(spark, sf_dir):
    """All maximal conversations, rendered."""
    return rendered(table(spark, sf_dir, "conversations"))


SQL = """
WITH conv AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id),
dropped AS (
  SELECT a.conv_id FROM conv a JOIN conv b ON a.turns[1] = b.turns[1]
  WHERE (len(a.turns) < len(b.turns) AND list_slice(b.turns, 1, len(a.turns)) = a.turns) OR (a.turns = b.turns AND b.conv_id < a.conv_id))
SELECT conv_id, len(turns)::BIGINT AS n_turns,
  array_to_string(list_transform(turns, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) || '<|end|>' || chr(10)), '') AS text
FROM conv WHERE conv_id NOT IN (SELECT conv_id FROM dropped)
"""
