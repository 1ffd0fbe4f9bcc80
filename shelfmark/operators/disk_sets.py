"""Sets of disks of dated names, each slot filled as of the set's version, and disks borrowed from other editions.

A catalogue lists only the disks that a new version changed, so disk 1 of v1.1 goes with disk 2 of v1.0. Every first
disk anchors a set; so does the newest first disk that fits flags which only other disks carry. A slot
takes the newest disk that isn't newer than the anchor and whose flags fit. No pairs of disks are made: sets of flags
are paired, each disk is listed once for each set of flags it fits, and one ordered sweep carries the last disk of a
slot on to the anchors behind it.

Sets that lack disks, of a game that has no complete set of as many disks, borrow from other editions of the same
title and publisher: all that is missing or nothing. Demands and offers of one kind are one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import disks, flags, keys
from shelfmark.functions.names import date_key, strip_ext
from shelfmark.operators.select import first_difference, sorts
from shelfmark.sources.work import saved

GAME = ["dat", "game"]
GROUP = [*GAME, "part", "total"]
NEWEST = ["vkey", "date"]
#: What a slot knows of its disk.
DISK = ["slot", "key", "name", "flags", "played", "cracked", "modifications"]
#: Sameness that a borrowed disk must have, and what it must fit.
SHELF = ["dat", "title", "publisher", "total", "slot", "states"]


def _columns(items: DataFrame) -> DataFrame:
    """What sets need of prepared items with a ``vkey``: slot and total of the disk, flags, ranks, texts of keys."""
    t = F.col("t")
    identity = keys.identity_key(t)
    told = F.when(t["languages_implied"], F.array().cast("array<string>")).otherwise(t["languages"])
    return items.select(
        *GAME,
        "key",
        "name",
        "vkey",
        keys.key_text(keys.partition_key(t)).alias("part"),
        t["disk"]["number"].alias("slot"),
        t["disk"]["total"].alias("total"),
        date_key(F.coalesce(t["date"], F.lit(""))).alias("date"),
        F.array_sort(F.array_distinct(t["dump_flags"])).alias("flags"),
        t["dump_flags"].alias("written"),
        F.get(t["flags"], t["disk_place"] - 1).alias("disk_flag"),
        F.lower(t["title"]).alias("title"),
        F.lower(t["publisher"]).alias("publisher"),
        F.to_json(identity["states"]).alias("states"),
        t["classes"].alias("classes"),
        t["played"].alias("played"),
        t["cracked"].alias("cracked"),
        t["modifications"].alias("modifications"),
        t["platform_rank"].alias("platform_rank"),
        F.struct(t["regions"].alias("country"), F.struct(t["played"], told).alias("language"), F.to_json(identity["edition"]).alias("edition"), t["version"].alias("version"), date_key(F.coalesce(t["date"], F.lit(""))).alias("year")).alias("about"),
        disks.edition(F.col("name"), F.get(t["flags"], t["disk_place"] - 1), t["publisher"]).alias("edition"),
    )


def is_disk(t: Column) -> Column:
    return F.coalesce((t["disk"]["total"] >= 2) & (t["disk"]["number"] >= 1), F.lit(False))


def _preferred() -> list[Column]:
    """The order of the disks at hand for a slot: the newest, then those whose flags fit best."""
    return [F.desc("vkey"), F.desc("date"), F.asc("fit"), F.char_length("name").asc(), F.asc("name"), F.asc("key")]


def _preferred_last() -> list[Column]:
    """The same the other way round, for disks of one version."""
    return [F.asc("date"), F.desc("fit"), F.char_length("name").desc(), F.desc("name"), F.desc("key")]


def _fitting(parts: DataFrame, group: list[str]) -> DataFrame:
    """``parts`` listed once for each set of flags of their group that they fit: adds wanted, fit."""
    sets = parts.select(*group, "flags").distinct()
    pairs = sets.join(sets.withColumnRenamed("flags", "wanted"), group).withColumn("fit", disks.fit(F.col("flags"), F.col("wanted"))).where("fit is not null")
    return parts.join(pairs, [*group, "flags"])


def _plans(parts: DataFrame, near: DataFrame) -> DataFrame:
    """A row for each set to fill: GROUP, wanted, vkey (its limit), head (the disk it begins with), about (the disk
    whose flags it has), nth (of equal sets the first counts). Without a first disk in the group, the newest begins."""
    disk = F.struct(*DISK, "vkey", "date", "platform_rank", "written", "disk_flag", "states", "classes", "title", "publisher", "about")
    first = parts.where("slot = 1").select(*GROUP, F.col("flags").alias("wanted"), "vkey", disk.alias("head"), disk.alias("of"), F.lit(0).alias("nth"))
    anchored = parts.withColumn("anchored", F.max(F.col("slot") == 1).over(Window.partitionBy(*GROUP)))
    newest = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("vkey"), F.desc("date"), F.char_length("name"), F.desc("name")))
    alone = anchored.where("not anchored").withColumn("n", newest).where("n = 1").select(*GROUP, F.col("flags").alias("wanted"), "vkey", disk.alias("head"), disk.alias("of"), F.lit(0).alias("nth"))
    own = first.select(*GROUP, F.col("wanted").alias("flags")).distinct()
    others = anchored.where("anchored").join(own, [*GROUP, "flags"], "left_anti")
    others = others.groupBy(*GROUP, F.col("flags").alias("wanted")).agg(F.min_by(disk, F.struct("name", "key")).alias("of"))
    fitting = near.where("slot = 1").withColumn("n", F.row_number().over(Window.partitionBy(*GROUP, "wanted").orderBy(*_preferred()))).where("n = 1")
    more = others.join(fitting.select(*GROUP, "wanted", "vkey", disk.alias("head")), [*GROUP, "wanted"]).select(*GROUP, "wanted", "vkey", "head", "of", F.lit(1).alias("nth"))
    return first.unionByName(alone).unionByName(more)


def _swept(plans: DataFrame, near: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds ``disks``: the disks of each set by slot, the newest that fits and isn't newer than the set."""
    there = parts.groupBy(*GROUP).agg(F.collect_set("slot").alias("there"))
    wanted = plans.join(there, GROUP).withColumn("slot", F.explode("there")).drop("there").where(F.col("slot") != F.col("head.slot"))
    disk = F.struct(*DISK)
    donors = near.select(*GROUP, "wanted", "slot", "vkey", F.lit(0).alias("is_plan"), "date", "fit", "name", "key", disk.alias("disk"))
    asked = wanted.select(*GROUP, "wanted", "slot", "vkey", F.lit(1).alias("is_plan"), "head", "of", "nth")
    # donors of one version come before the sets of it, the one to prefer last
    order = Window.partitionBy(*GROUP, "wanted", "slot").orderBy("vkey", "is_plan", *_preferred_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = donors.unionByName(asked, allowMissingColumns=True).withColumn("last", F.last("disk", ignorenulls=True).over(order))
    filled = both.where("is_plan = 1 and last is not null").groupBy(*GROUP, "wanted", "head.key", "of.key", "nth").agg(F.collect_list("last").alias("others"))
    filled = filled.toDF(*GROUP, "wanted", "head_key", "of_key", "nth", "others")
    named = plans.withColumns({"head_key": F.col("head.key"), "of_key": F.col("of.key")}).join(filled, [*GROUP, "wanted", "head_key", "of_key", "nth"], "left")
    own = F.struct(*[F.col(f"head.{c}").alias(c) for c in DISK])
    every = F.array_sort(F.concat(F.array(own), F.coalesce("others", F.array().cast(near.select(F.array(disk).alias("a")).schema["a"].dataType))))
    return named.withColumn("disks", every).drop("others", "head_key", "of_key")


def own_sets(parts: DataFrame) -> DataFrame:
    """The sets that the disks of each group make by themselves: GROUP, wanted, head, of, disks, missing.

    Parts: the columns of ``_columns`` of names with a disk of two or more, each name once. Sets of the same disks
    are one, and one that lacks disks and is a part of another is left out."""
    near = saved(_fitting(parts, GROUP), "fitting-disks")
    sets = _swept(_plans(parts, near), near, parts)
    refs = F.transform("disks", lambda d: F.struct(d["slot"], d["key"]))
    one = Window.partitionBy(*GROUP, "refs").orderBy("nth", "of.name", "of.key")
    sets = sets.withColumn("refs", refs).withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    numbers = F.transform("disks", lambda d: d["slot"])
    sets = sets.withColumn("missing", F.array_except(F.sequence(F.lit(1), F.col("total")), numbers))
    # a set inside another has the same first disk, so only sets of one first disk are compared: one for each flag set
    larger = F.collect_list("refs").over(Window.partitionBy(*GROUP, "head.key"))
    inside = F.exists("larger", lambda o: (F.size(o) > F.size("refs")) & (F.size(F.array_except(F.col("refs"), o)) == 0))
    return sets.withColumn("larger", larger).where((F.size("missing") == 0) | ~inside).drop("larger", "refs", "nth")


def _lent(demands: DataFrame, pool: DataFrame, languages: list[str]) -> DataFrame:
    """For each kind of demand the disk to borrow, if there is one: the same edition first, then one in a
    selected language, then any; of these the newest, then the one whose flags fit best."""
    played = F.arrays_overlap("played", F.array(*map(F.lit, languages))) if languages else F.lit(True)
    kinds = [*SHELF, "classes", "flags", "game", "part"]
    offer = F.struct(*DISK, *NEWEST, "about", "edition")
    best = F.row_number().over(Window.partitionBy(*kinds, played).orderBy(F.desc("vkey"), F.desc("date"), F.char_length("name"), "name", "key"))
    offers = pool.withColumn("chosen", played).withColumn("n", best).where("n = 1").select(*SHELF, F.col("classes").alias("has"), "flags", F.col("game").alias("of_game"), F.col("part").alias("of_part"), "chosen", offer.alias("lent"))
    wants = [*SHELF, "classes", "wanted", "game", "part"]
    met = demands.select(*wants).distinct().join(offers, SHELF).withColumn("fit", disks.fit(F.col("flags"), F.col("wanted")))
    met = met.where((F.size(F.array_except("classes", "has")) == 0) & F.col("fit").isNotNull())
    same = (F.col("game") == F.col("of_game")) & (F.col("part") == F.col("of_part"))
    tier = F.when(same, 0).when(F.col("chosen"), 1).otherwise(2)
    order = Window.partitionBy(*wants).orderBy(tier, F.desc("lent.vkey"), F.desc("lent.date"), "fit", F.char_length("lent.name"), "lent.name", "lent.key")
    return met.withColumn("n", F.row_number().over(order)).where("n = 1").select(*wants, "lent")


def with_borrowed(sets: DataFrame, pool: DataFrame, languages: list[str]) -> DataFrame:
    """Adds ``lent`` (disks of other editions by slot, with what tells them apart), and fills with them the anchored sets that
    lack disks, where the game has no complete set of as many disks: all that is missing or none.

    A disk must have the set's title, publisher, number of disks and state, run wherever its first disk does,
    and fit its flags; it may be newer. ``pool`` has the columns of ``_columns`` with version keys by shelf."""
    whole = F.size("missing") == 0
    any_whole = F.max(whole).over(Window.partitionBy(*GAME, "total"))
    sets = sets.withColumn("needs", ~whole & ~any_whole & (F.col("head.slot") == 1)).withColumn("id", F.struct("part", "wanted", "head.key", "of.key"))
    head = [F.col(f"head.{c}").alias(c) for c in ("title", "publisher", "states", "classes")]
    demands = sets.where("needs").select(*GROUP, "id", "wanted", *head, F.explode("missing").alias("slot"), F.col("head.about").alias("anchor"))
    met = demands.join(_lent(demands, pool, languages), [*SHELF, "classes", "wanted", "game", "part"])
    differences = F.array_compact(F.array(*[F.when(F.col(f"anchor.{d}") != F.col(f"lent.about.{d}"), d) for d in ("country", "language", "edition", "version", "year")]))
    note = F.struct(*[F.col(f"lent.{c}").alias(c) for c in DISK], "lent.edition", differences.alias("differences"))
    found = met.groupBy(*GAME, "total", "id").agg(F.array_sort(F.collect_list(note)).alias("lent"))
    joined = sets.join(found, [*GAME, "total", "id"], "left")
    lent = F.when(F.size("lent") == F.size("missing"), F.col("lent"))
    joined = joined.withColumn("lent", lent)
    plain = F.transform("lent", lambda d: F.struct(*[d[c].alias(c) for c in DISK]))
    filled = F.col("lent").isNotNull()
    return joined.withColumn("disks", F.when(filled, F.array_sort(F.concat("disks", plain))).otherwise(F.col("disks"))).withColumn("missing", F.when(filled, F.array().cast("array<int>")).otherwise(F.col("missing"))).drop("id", "needs")


def _singles(items: DataFrame) -> DataFrame:
    disk = F.struct(F.lit(1).alias("slot"), *DISK[1:])
    head = F.struct(disk["slot"].alias("slot"), *DISK[1:], "vkey", "date", "platform_rank", "written", "disk_flag", "states", "classes", "title", "publisher", "about")
    return items.select(*GAME, "part", F.lit(1).alias("total"), F.col("flags").alias("wanted"), head.alias("head"), head.alias("of"), F.array(disk).alias("disks"), F.array().cast("array<int>").alias("missing"))


def _ranked(sets: DataFrame, languages: list[str]) -> DataFrame:
    """Adds the set's name, the flags that tell its variant, and what choices look at: lang, cracked, modifications, refs."""
    every = F.flatten(F.transform("disks", lambda d: d["played"]))
    written = F.col("of.written")
    telling = F.filter(written, lambda f: ~disks.is_neutral(f))
    shared = F.filter(written, lambda f: ~disks.is_neutral(f) | F.forall("disks", lambda d: F.array_contains(d["flags"], f)))
    title = disks.set_title(F.col("head.name"), F.col("head.disk_flag"))
    name = F.when(F.col("total") == 1, strip_ext(F.col("head.name"))).otherwise(F.concat(title, disks.flag_text(shared)))
    return sets.withColumns(
        {
            "set_name": name,
            "telling": F.array_join(telling, "|"),
            "lang": flags.rank_in(every, languages) if languages else F.lit(0),
            "cracked": F.exists("disks", lambda d: d["cracked"]),
            "modifications": F.aggregate("disks", F.lit(0), lambda n, d: n + d["modifications"]),
            "refs": F.transform("disks", lambda d: F.struct(d["slot"], d["key"])),
        }
    )


def chosen_sets(items: DataFrame, pool: DataFrame | None, languages: list[str], best: bool = True) -> DataFrame:
    """Every set of every game with ``kept``: the best by language, crack, chipset, newest version and date, modifications
    and name; or, without ``best``, the newest of each variant, language and chipset.

    Items: prepared ones with a ``vkey`` by game; of equal names of a game the first by key stands for all. ``pool``
    has the disks that may be borrowed, or None."""
    rows = _columns(items.withColumn("_disk", is_disk(F.col("t"))).where("_disk"))
    one = F.row_number().over(Window.partitionBy(*GAME, "name").orderBy("key"))
    parts = saved(rows.withColumn("n", one).where("n = 1").drop("n"), "set-disks")
    sets = own_sets(parts)
    if pool is not None:
        offers = _columns(pool)
        once = F.row_number().over(Window.partitionBy(*SHELF, "name").orderBy("key"))
        sets = with_borrowed(saved(sets, "own-sets"), offers.withColumn("n", once).where("n = 1").drop("n"), languages)
    singles = _singles(_columns(items.where(~is_disk(F.col("t")))))
    every = _ranked(sets.unionByName(singles, allowMissingColumns=True), languages)
    newest = [("newer version", F.col("head.vkey"), True), ("newer date", F.col("head.date"), True)]
    named = [F.lower("head.name"), F.col("head.name"), F.col("refs")]
    whole = F.size("missing") == 0
    group, criteria = [*GAME, "part", "telling"], newest
    if best:
        group = GAME
        criteria = [("preferred language", F.col("lang"), False), ("cracked", F.col("cracked"), True), ("better chipset", F.col("head.platform_rank"), False), *newest, ("fewer modifications", F.col("modifications"), False)]
    order = Window.partitionBy(*group).orderBy(F.desc(whole), *sorts(criteria), *named)
    placed = every.withColumns({"place": F.row_number().over(order), "why": first_difference(criteria, order)})
    return placed.withColumn("kept", (F.col("place") == 1) & whole)


def decided(items: DataFrame, sets: DataFrame) -> DataFrame:
    """key, in_kept, any_complete, winner (the kept set's name), why (its best complete set yields to it), missing of each item; ``missing`` is that of the set with the
    fewest gaps that has the item, or else what no fitting disk of the game fills."""
    game = sets.groupBy(*GAME).agg(F.max(F.size("missing") == 0).alias("any_complete"), F.min(F.when(F.col("kept"), F.struct(F.lower("set_name"), F.col("set_name").alias("name"))))["name"].alias("winner"))
    best_whole = F.min(F.when(F.size("missing") == 0, F.struct("place", "why")))["why"].alias("why")
    of_sets = sets.select("kept", "missing", "place", "why", F.explode("disks").alias("d")).groupBy(F.col("d.key").alias("key")).agg(F.max("kept").alias("in_kept"), best_whole, F.min(F.when(F.size("missing") > 0, F.struct(F.size("missing").alias("n"), "missing")))["missing"].alias("missing"))
    t = F.col("t")
    rows = items.select(*GAME, "key", t["disk"]["number"].alias("slot"), t["disk"]["total"].alias("total"), F.array_sort(F.array_distinct(t["dump_flags"])).alias("flags"))
    disk_rows = rows.where("total >= 2 and slot >= 1")
    # disks of no set at all: slots for which the game has a disk that fits theirs
    group = [*GAME, "total"]
    free = disk_rows.join(of_sets.select("key"), "key", "left_anti")
    near = _fitting(disk_rows.select(*group, "slot", "flags").distinct(), group).groupBy(*group, "wanted").agg(F.collect_set("slot").alias("have"))
    gaps = free.join(near, (free.dat == near.dat) & (free.game == near.game) & (free.total == near.total) & (free.flags == near.wanted)).select(free.key, free.slot, free.total, "have")
    every = F.sequence(F.lit(1), F.col("total"))
    left = F.array_except(every, F.col("have"))
    gaps = gaps.select("key", F.when(F.size(left) > 0, left).otherwise(F.array_remove(every, F.col("slot"))).alias("gaps"))
    none = F.array().cast("array<int>")
    joined = rows.select(*GAME, "key").join(game, GAME, "left").join(of_sets, "key", "left").join(gaps, "key", "left")
    return joined.select("key", F.coalesce("in_kept", F.lit(False)).alias("in_kept"), F.coalesce("any_complete", F.lit(False)).alias("any_complete"), F.coalesce("winner", F.lit("")).alias("winner"), F.coalesce("why", F.lit("complete set")).alias("why"), F.coalesce("missing", "gaps", none).alias("lacking"))


def borrowed(sets: DataFrame) -> DataFrame:
    """dat, set_name, slot, key, name, differences, text of the disks that kept sets borrow."""
    d = F.col("d")
    lent = sets.where("kept and lent is not null").select("dat", "set_name", F.explode("lent").alias("d"))
    other = F.arrays_overlap(d["differences"], F.array(*map(F.lit, ("country", "language", "edition"))))
    edition = F.when(d["edition"] == "", "untagged").otherwise(d["edition"])
    source = F.when(other, F.concat(F.lit("the "), edition, F.lit(" edition"))).otherwise("another version of the same edition")
    text = F.concat(F.lit("borrowed as disk "), d["slot"].cast("string"), F.lit(" of "), F.col("set_name"), F.lit(" from "), source)
    return lent.select("dat", "set_name", d["slot"].alias("slot"), d["key"].alias("key"), d["name"].alias("name"), d["differences"].alias("differences"), text.alias("text"))


def borrow_summary(sets: DataFrame) -> DataFrame:
    """dat, sets and disks that borrow, and how often each difference occurs: what a selection took from other editions."""
    lent = borrowed(sets)
    each = lent.select("dat", F.explode_outer("differences").alias("what")).where("what is not null").groupBy("dat", "what").agg(F.count(F.lit(1)).alias("n"))
    by = each.groupBy("dat").agg(F.array_sort(F.collect_list(F.struct("what", "n"))).alias("differences"))
    return lent.groupBy("dat").agg(F.countDistinct("set_name").alias("sets"), F.count(F.lit(1)).alias("disks")).join(by, "dat", "left")
