"""Cumulative-snapshot collapse of logged conversations, and their rendering.

A chat that goes on is often logged again after each turn, so a log holds conversations that are
the beginning of longer ones. Each turn gets a rolling hash of the turns up to it; a conversation
whose last hash is that of an inner turn of another one is a snapshot, and an anti-join leaves it
out. Among equal conversations the one with the smallest conv_id stays.

A hash of a beginning is a sum of hashes of (position, role, text), four sums of 32 bits each. Sums
can be taken in parts: turns are dealt out by conversation and block of turn numbers, and sums of
whole blocks are added, so a very long conversation is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

BLOCK = 256
LOW = 0xFFFFFFFF
SUMS = ["h0", "h1", "h2", "h3"]
KEY = ["position", *SUMS]


def blocked(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, turn, role, text; null roles and texts are empty, rows without a conv_id left out."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))


def _before(column: str) -> Column:
    """The sum of a column over a conversation's earlier blocks."""
    return F.coalesce(F.sum(column).over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _inside() -> Window:
    """A block's turns in their order; nulls come first."""
    return Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")


def placed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``blocks(conv_id, block, n_before)`` with their position in the conversation, from 1."""
    joined = rows.hint("merge").join(blocks, ["conv_id", "block"])
    return joined.withColumn("position", F.row_number().over(_inside()) + F.col("n_before")).drop("n_before")


def rolled(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """conv_id, position, h0 to h3 (of the turns up to this one), last; from blocked rows.

    Turns go by number, nulls first, then by role and text; repeated rows stay and are turns of their own.
    The sums inside a block are saved without texts, and the sums of earlier blocks are added to them.
    """
    a, b = F.xxhash64(F.lit(17), "position", "role", "text"), F.xxhash64(F.lit(29), "text", "role", "position")
    parts = [a.bitwiseAND(LOW), F.shiftrightunsigned(a, 32), b.bitwiseAND(LOW), F.shiftrightunsigned(b, 32)]
    running = _inside().rowsBetween(Window.unboundedPreceding, 0)
    inner = placed(rows, blocks).withColumns({f"g{i}": part for i, part in enumerate(parts)})
    inner = saved(inner.select("conv_id", "block", "position", *[F.sum(f"g{i}").over(running).alias(f"r{i}") for i in range(4)]), "turn-hashes")
    # no part is negative, so a block's greatest running sum is its whole sum
    sums = inner.groupBy("conv_id", "block").agg(F.max("position").alias("upto"), *[F.max(f"r{i}").alias(f"b{i}") for i in range(4)])
    length = F.max("upto").over(Window.partitionBy("conv_id"))
    sums = sums.select("conv_id", "block", length.alias("length"), *[_before(f"b{i}").alias(f"b{i}") for i in range(4)])
    whole = inner.hint("merge").join(sums, ["conv_id", "block"])
    return saved(whole.select("conv_id", "position", *[(F.col(f"r{i}") + F.col(f"b{i}")).alias(f"h{i}") for i in range(4)], (F.col("position") == F.col("length")).alias("last")), "rolling-hashes")


def maximal(rolling: DataFrame) -> DataFrame:
    """conv_ids that begin no longer conversation, one of each set of equal ones.

    Inner beginnings and whole conversations are made distinct before the anti-join, so a first
    turn that many share is one row on each side.
    """
    inner = rolling.where("not last").select(*KEY).distinct()
    whole = rolling.where("last").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"))
    return whole.hint("merge").join(inner, KEY, "left_anti").select("conv_id")


def rendered(role: Column, text: Column) -> Column:
    """One turn in a chat layout with role markers; markers in the role and the text are taken apart."""

    def safe(x: Column) -> Column:
        return F.replace(x, F.lit("<|im_"), F.lit("<| im_"))

    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def render_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The turns of maximal conversations: conv_id, position, turn, role, segment.

    A conversation's segments in order of position are its rendered text. One row a turn, so its
    length is not bounded by a row. Null roles and texts are empty, null turns come first, rows without
    a conv_id are left out, repeated rows are turns of their own. A table without rows gives no rows;
    other columns are not read. Texts are shuffled twice: for the hashes, and of kept conversations.
    """
    rows = blocked(turns, block)
    counted = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = saved(counted.select("conv_id", "block", _before("n").alias("n_before")), "turn-blocks")
    kept = blocks.hint("merge").join(maximal(rolled(rows, blocks)), "conv_id")
    return placed(rows, kept).select("conv_id", F.col("position").cast("long").alias("position"), "turn", "role", rendered(F.col("role"), F.col("text")).alias("segment"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered turns of all maximal conversations, as ``render_chats`` defines them."""
    return render_chats(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS position,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, position, n,
    md5(string_agg(md5(role) || md5(text), ',') OVER (PARTITION BY conv_id ORDER BY position)) AS h
  FROM t
), kept AS (
  SELECT min(conv_id) AS conv_id FROM p AS w WHERE position = n
    AND NOT EXISTS (SELECT 1 FROM p AS i WHERE i.position < i.n AND i.position = w.position AND i.h = w.h)
  GROUP BY position, h
)
SELECT conv_id, position, turn, role,
  '<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS segment
FROM t WHERE conv_id IN (SELECT conv_id FROM kept)
"""
