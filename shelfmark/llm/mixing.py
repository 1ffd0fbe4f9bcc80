"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source that would get more than its words times the highest
number of epochs is clamped there, and what it can't use is shared by the others, again and again until none is
above its limit. A source's target then is a number of whole repetitions of all its documents and a rest; the
rest is filled by its documents in a seeded random order, the last of them with its first words.

The random order is that of hexadecimal hashes. Where the rest of a source ends is found by sums of words for
each beginning of a hash, longer ones round by round, so that no source is ever sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, saved, table, whole_text

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Hexadecimal signs that one round of sums looks at, and of a whole key: a hash, then the row's number.
SIGNS, KEY_SIGNS = 2, 48
#: Rows of a source among which its rest ends, at most, before they are sorted.
SORTED_ROWS = 10_000
#: Tables of sources are broadcast up to so many rows and characters of names, and joined by a shuffle beyond.
BROADCAST_SOURCES, BROADCAST_NAMES = 50_000, 4_000_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def cycled(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``sources`` with a weight each: those of ``weights`` in turn, by code points, the null source last."""
    rows = numbered(sources, "mix-sources", F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))[(F.pmod(F.col("id") - 1, F.lit(len(weights)))).cast("int")]
    return rows.select(*sources.columns, turn.cast("double").alias("weight"))


def water_filled(sources: DataFrame, budget: float) -> DataFrame:
    """Adds ``target``: shares of ``budget`` by ``weight``, none above ``cap``, what is above one's cap shared
    by the others in proportion.

    A round is one sum over the sources. All sources end at their caps if these add up to less than the budget.
    """
    rest, weight, clamped = budget, None, -1
    while True:
        over = F.lit(False) if weight is None else F.col("weight") * rest > F.col("cap") * weight
        now = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if now["n"] == clamped or not now["weight"]:
            break
        clamped, rest, weight = now["n"], budget - (now["cap"] or 0), now["weight"]
    if not now["weight"]:
        return sources.withColumn("target", F.col("cap").cast("double"))
    share = F.when(over, F.col("cap").cast("double")).otherwise(F.col("weight") * rest / weight)
    return sources.withColumn("target", share)


def _by_source(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    named = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(F.broadcast(named) if small else named.hint("merge"), same).drop("_source")


def _ends(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """For each source with a rest: the beginning of keys within which its rest ends, and the words still ``left``
    there. All keys of a smaller beginning are taken whole."""
    state = plan.where("rest > 0").select("source", F.lit("").alias("begin"), F.col("rest").alias("left"))
    for signs in range(SIGNS, KEY_SIGNS + 1, SIGNS):
        inside = _by_source(rows, state, small).where(F.col("key").startswith(F.col("begin")))
        sums = inside.groupBy("source", "left", F.substring("key", 1, signs).alias("begin")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("begin")))
        there = upto.where("upto >= left").groupBy("source").agg(F.min_by(F.struct("begin", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "n"), "begin").alias("b"))
        found = saved(there.select("source", "b.*"), "mix-ends")
        state = found.drop("n")
        if (found.agg(F.max("n")).first()[0] or 0) <= SORTED_ROWS:
            break
    return state


def mixed(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken, ``keep``.

    ``target`` is the source's and ``taken`` the document's; a document is taken ``taken div size`` times whole,
    and at most one of a source once more in part. Taken words of a source are its target, rounded. No
    document is taken more than ``epochs`` times. The same rows and seed give the same mix.

    A null text has no words; null is a source of its own, the last. A source without words has a target of
    0. Rows of one doc_id and text are each counted, and where a rest ends among repeated rows, as many
    of them are taken as fit. An empty table gives no rows; columns other than ``keep`` are not read.
    """
    if epochs != int(epochs):
        raise ValueError("epochs is a whole number: documents are repeated as wholes up to it")
    text = whole_text()
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    chance = F.md5(F.concat(F.lit(f"{seed}:"), doc_id, F.lit(":"), text))
    number = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    # saved once, so that the numbers of rows stay the same in all rounds
    rows = saved(documents.select("doc_id", "source", n_words(text).alias("size"), F.concat(chance, number).alias("key"), *keep), "mix-documents")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = saved(cycled(sizes, weights).withColumn("cap", F.col("source_size") * epochs), "mix-weights")
    all_of = sources.agg(F.sum("source_size").alias("words"), F.count(F.lit(1)).alias("n"), F.sum(F.length("source")).alias("names")).first()
    small = all_of["n"] <= BROADCAST_SOURCES and (all_of["names"] or 0) <= BROADCAST_NAMES
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("long")
    targets = water_filled(sources, share * (all_of["words"] or 0)).withColumn("goal", goal).withColumn("whole", whole)
    plan = saved(targets.withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size")).select("source", "source_size", "target", "whole", "rest"), "mix-plan")
    named = plan.withColumnRenamed("source", "_source")
    ends = named.join(_ends(rows, plan, small), F.col("source").eqNullSafe(F.col("_source")), "left")
    ends = saved(ends.select(F.col("_source").alias("source"), "source_size", "target", "whole", "begin", "left"), "mix-plan")
    placed = _by_source(rows, ends, small).withColumn("head", F.substring(F.col("key"), F.lit(1), F.length("begin")))
    before = F.col("begin").isNotNull() & (F.col("head") < F.col("begin"))
    there = F.coalesce(F.col("head") == F.col("begin"), F.lit(False))
    clear = placed.where(~there).withColumn("more", F.when(before, F.col("size")).otherwise(F.lit(0)))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(upto, F.lit(0))))
    last = placed.where(there).withColumn("more", more)
    taken = (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken")
    return clear.unionByName(last).select("doc_id", "source", "size", "source_size", "target", taken, *keep)


def repetitions(mix: DataFrame) -> DataFrame:
    """The documents of a mix (with its ``text`` kept) as often as they are taken: a row for each ``repetition``,
    from 1. One taken in part has its first words, with a plain space between them."""
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mix.where("taken > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1), times)))
    left = (F.col("taken") - (F.col("repetition") - 1) * F.col("size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), 1, left), " ")
    return rows.withColumn("text", F.when(left < F.col("size"), part).otherwise(F.col("text")))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of their words with weights 5, 2, 1 and at most two epochs."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE nth % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2 * source_size AS cap FROM s
), o AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others,
         row_number() OVER (ORDER BY cap / weight, nth) AS step
  FROM w
), f AS (SELECT min(step) AS step FROM o WHERE weight * rest <= cap * others), t AS (
  SELECT o.source, o.source_size, CASE WHEN f.step IS NULL OR o.step < f.step THEN CAST(o.cap AS DOUBLE) ELSE o.weight * l.rest / l.others END AS target
  FROM o CROSS JOIN f LEFT JOIN o AS l ON l.step = f.step
), g AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.goal - g.whole * g.source_size AS left_,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, left_ - upto)) AS BIGINT) AS taken
FROM c
"""
