"""Chat formatting: logged snapshots that prefix a longer conversation collapse into it, then the rest is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whetstone.llm.common import durable

#: Turns that one rendered row holds; longer conversations have several parts.
PART = 256


def _ahead(rows: DataFrame, value: str, fold, name: str) -> DataFrame:
    """For each (conv, block) the fold of `value` over the blocks before it."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(fold(value).over(before), F.lit(0)))


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, by turn, role and text, nulls first. Long conversations are ranked in blocks."""
    block = F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 62)))
    rows = turns.withColumn("block", block)
    counts = _ahead(rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")), "n", F.sum, "ahead").select("conv_id", "block", "ahead")
    rank = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text"))))
    return rows.withColumn("rank", rank).join(counts, ["conv_id", "block"]).withColumn("pos", F.col("ahead") + F.col("rank")).select("conv_id", "pos", "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, p1, p2): two 64-bit hashes of the first `pos` turns. A turn's hash holds its place, so their xor keeps the order."""
    block = F.floor((F.col("pos") - 1) / PART)
    one = lambda seed: F.xxhash64(F.lit(seed), "pos", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "pos", block.alias("block"), one(1).alias("h1"), one(2).alias("h2"))
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    sums = _ahead(_ahead(sums, "b1", F.bit_xor, "a1"), "b2", F.bit_xor, "a2").select("conv_id", "block", "a1", "a2")
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.withColumn("h1", F.bit_xor("h1").over(within)).withColumn("h2", F.bit_xor("h2").over(within))
    return rolled.join(sums, ["conv_id", "block"]).select("conv_id", "pos", F.col("h1").bitwiseXOR(F.col("a1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("a2")).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of each conversation that is no prefix of another; of equal ones the smallest."""
    prefixes = durable(prefix_hashes(turns))
    length = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n"))
    ends = prefixes.join(length, "conv_id")
    whole = ends.where("pos = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    inner = ends.where("pos < n").select(F.col("pos").alias("n"), "p1", "p2").distinct()
    return whole.join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id")


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, text): maximal conversations, each turn as `<|role|>`, its text and a line feed.

    Turns go by turn, then role and text, nulls first; null roles and texts render as empty. Rows without a conversation
    are left out, repeated rows are turns of their own. A part holds PART turns, so a text of any length is rendered whole in its
    part. No rows give none; other columns are ignored and may have any names.
    """
    turns = conversations.select(conversations[conv_col].alias("conv_id"), conversations[turn_col].cast("long").alias("turn"), conversations[role_col].cast("string").alias("role"), conversations[text_col].cast("string").alias("text")).where("conv_id is not null")
    turns = durable(numbered(turns))
    kept = turns.join(durable(maximal(turns)), "conv_id", "left_semi")
    piece = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = kept.groupBy("conv_id", F.floor((F.col("pos") - 1) / PART).alias("part")).agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("x"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.col("x.piece"), "").alias("text"))


ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n, md5(CAST(list([role, text]) OVER (PARTITION BY conv_id ORDER BY pos) AS VARCHAR)) AS h FROM t),
w AS (SELECT n, h, min(conv_id) AS conv_id FROM c WHERE pos = n GROUP BY n, h),
k AS (SELECT conv_id FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.pos < c.n AND c.pos = w.n AND c.h = w.h))
SELECT conv_id, (pos - 1) // {PART} AS part, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) AS text
FROM t WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id, (pos - 1) // {PART}
"""
