"""Multi-part sets: completeness, slots filled as of a date, compatible flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completeness(parts: DataFrame, group: list[str], slot: str) -> DataFrame:
    """total (the highest slot), present and missing slots of each set, and whether it is complete."""
    sets = parts.groupBy(*group).agg(F.max(slot).alias("total"), F.array_sort(F.collect_set(slot)).alias("present"))
    gone = F.array_except(F.sequence(F.lit(1), F.col("total")), F.col("present"))
    return sets.withColumn("missing", gone).withColumn("complete", F.size("missing") == 0)


def missing_slots(parts: DataFrame, group: list[str], slot: str) -> DataFrame:
    return completeness(parts, group, slot).select(*group, F.explode("missing").alias("slot"))


def as_of(anchors: DataFrame, donors: DataFrame, group: str, time: str, columns: list[str], tie: str) -> DataFrame:
    """Each anchor with ``columns`` of the newest donor of its group that isn't newer, or nulls.

    Anchors and donors are put into one order and the last donor is carried on: one shuffle, and no
    pairs of a group are made. Of donors of one time the one with the highest ``tie`` counts.
    """
    picked = F.struct(F.col(time).alias("_at"), *[F.col(c) for c in columns])
    both = anchors.withColumn("_anchor", F.lit(1)).withColumn("_donor", F.lit(None).cast(donors.select(picked.alias("p")).schema["p"].dataType))
    side = donors.select(F.col(group), F.col(time), F.col(tie).alias("_tie"), picked.alias("_donor"), F.lit(0).alias("_anchor"))
    order = Window.partitionBy(group).orderBy(time, "_anchor", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.unionByName(side, allowMissingColumns=True).withColumn("_last", F.last("_donor", ignorenulls=True).over(order))
    return rows.where("_anchor = 1").select(*anchors.columns, *[F.col(f"_last.{c}").alias(c) for c in columns])


def fits(anchor: Column, other: Column) -> Column:
    """Whether all flags of the anchor are among the other's."""
    return F.size(F.array_except(anchor, other)) == 0


def tiered(rows: DataFrame, group: list[str], tier: Column, newest: Column, tie: Column) -> DataFrame:
    """One row of each group: lowest tier, then newest, then the tie-breaker."""
    order = Window.partitionBy(*group).orderBy(tier, newest.desc(), tie)
    return rows.withColumn("tier", tier).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
