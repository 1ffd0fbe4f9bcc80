"""Multi-disk sets: a set for each first disk, its other slots filled as of its version.

Parts: identity, slot, total, version (array<int>), flags (array<string>), key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.sets import fits


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key to all tasks of a shuffle. Adaptive execution would put them into few: it goes by compressed
    sizes, and sorts hold many times as much."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _swept(parts: DataFrame) -> DataFrame:
    """identity, total, wanted, slot, anchor and own (version, fit, key of its disk, or null) of all slots of sets.

    No pairs of disks are made: sets of flags are paired, each disk is listed for those it fits, and one ordered sweep
    carries the last disk of a slot on to the anchors behind it. All that follows the two shuffles goes by identity and slot."""
    is_anchor, is_donor = F.col("slot") == 1, (F.col("slot") > 1) & (F.col("slot") <= F.col("total"))
    wanted = F.array_sort(F.array_distinct("flags")).alias("wanted")
    pairs = parts.where(is_anchor).select("identity", "total", wanted).distinct().join(parts.where(is_donor).select("identity", "total", "flags").distinct(), ["identity", "total"])
    pairs = pairs.where(fits(F.col("wanted"), F.col("flags"))).select("*", F.explode(F.sequence(F.lit(2), "total")).alias("slot"))
    # an anchor stands at each slot of its set
    places = F.when(is_anchor, F.sequence(F.lit(1), F.greatest("total", F.lit(1)))).when(is_donor & F.col("version").isNotNull(), F.array("slot"))
    rows = parts.select("identity", "total", "version", "flags", "key", is_anchor.alias("is_anchor"), F.explode(places).alias("slot"))
    left, right = _dealt(rows, "identity", "slot").alias("l"), _dealt(pairs, "identity", "slot").alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("identity", "slot", "total", "flags")]
    listed = left.join(right, [*same, ~F.col("l.is_anchor")], "left").select("l.*", F.when(F.col("l.is_anchor"), F.array_sort(F.array_distinct("l.flags"))).otherwise(F.col("r.wanted")).alias("wanted"))
    listed = listed.where("is_anchor or wanted is not null").select("identity", "total", "wanted", "slot", "version", F.size("flags").alias("fit"), "key", "is_anchor")
    # donors of one version come before the anchors of it, the one to prefer last
    order = Window.partitionBy("identity", "total", "wanted", "slot").orderBy("version", "is_anchor", F.desc("fit"), F.desc_nulls_first("key")).rowsBetween(Window.unboundedPreceding, 0)
    disk = F.struct("version", "fit", "key")
    known = F.col("identity").isNotNull() & F.col("total").isNotNull() & F.col("version").isNotNull() & F.col("wanted").isNotNull() & F.col("key").isNotNull()
    last = listed.withColumn("last", F.last(F.when(~F.col("is_anchor"), disk), ignorenulls=True).over(order)).where("is_anchor")
    return last.select("identity", "total", "wanted", "slot", F.col("key").alias("anchor"), F.when(F.col("slot") > 1, F.col("last")).when(known, disk).alias("own"))


def filled(parts: DataFrame, borrowed: DataFrame | None = None) -> DataFrame:
    """identity, anchor, slot, total, key and source (own or borrowed) of all slots of sets.

    A set is anchored on each first disk. A slot takes the newest disk of its identity that isn't
    newer than the anchor and has all its flags; of equals the one with the fewest other flags, then
    the smallest key. ``borrowed`` holds donors of other editions (the same columns and tier): sets
    that are short of a disk take from them by tier, then newest. Slots without a disk have no key.
    Disks may be listed more than once.
    """
    order = Window.partitionBy("identity", "anchor", "slot").orderBy(F.desc(F.col("own").isNotNull()), F.desc("own.version"), "own.fit", F.asc_nulls_last("own.key"), "total")
    best = _swept(parts).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("identity", "anchor", "slot", "total", F.col("wanted").alias("a_flags"), F.col("own.key").alias("key"))
    if borrowed is None:
        return best.select("identity", "anchor", "slot", "total", "key", F.when(F.col("key").isNotNull(), "own").alias("source"))
    donors = borrowed.select("identity", "slot", "total", F.col("key").alias("donor"), F.col("version").alias("d_version"), F.col("flags").alias("d_flags"), "tier")
    gaps = best.where("key is null").join(donors, ["identity", "slot", "total"]).where(fits(F.col("a_flags"), F.col("d_flags")))
    order = Window.partitionBy("identity", "anchor", "slot").orderBy("tier", F.desc("d_version"), "donor")
    lent = gaps.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("identity", "anchor", "slot", "donor")
    joined = best.join(lent, ["identity", "anchor", "slot"], "left")
    # all or nothing: a set that stays short of a disk borrows none
    whole = F.min(F.coalesce("key", "donor").isNotNull()).over(Window.partitionBy("identity", "anchor"))
    key = F.coalesce("key", F.when(whole, F.col("donor")))
    return joined.withColumn("whole", whole).select("identity", "anchor", "slot", "total", key.alias("key"), F.when(F.col("key").isNotNull(), "own").when(key.isNotNull(), "borrowed").alias("source"))


def resolved(slots: DataFrame) -> DataFrame:
    """identity, anchor, total, present (keys by slot, null for none) and complete of each set;
    incomplete sets whose disks are all in another set of the identity with more of them are left out."""
    sets = slots.groupBy("identity", "anchor").agg(F.first("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("slot", "key"))), lambda x: x["key"]).alias("keys"))
    sets = sets.withColumn("present", F.filter("keys", lambda k: k.isNotNull())).withColumn("complete", F.size("present") == F.size("keys"))
    other = sets.select("identity", F.col("anchor").alias("o_anchor"), F.col("present").alias("o_present"))
    inside = sets.where("not complete").join(other, "identity").where((F.col("anchor") != F.col("o_anchor")) & (F.size("present") < F.size("o_present")) & fits(F.col("present"), F.col("o_present")))
    return sets.join(inside.select("identity", "anchor").distinct(), ["identity", "anchor"], "left_anti")
