"""Keys of names: what makes two of them the same release, game, title or set.

Structs over a tags struct ``t`` with details (``flags.with_details``). Texts in keys are lower-cased; arrays
whose order says nothing are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import is_chipset, spelled
from .tags import ARCHIVE, DATED, DISC, without_publisher

# Kinds of flags that don't make another game, states that do, and labels of single disks.
SAME_GAME = ["date", "video", "serial", "alt", "distribution", "language"]
OTHER_STATES = ["pre_release", "prototype", "demo", "unreleased"]
DISK_LABELS = ["program", "data", "save", "boot", "game", "intro", "data disk", "save disk", "program disk", "game disk", "boot disk", "a", "b", "c", "d"]


def clean_dump_flags(t: Column) -> Column:
    return F.filter(t["dump_flags"], lambda f: f != "!")


def _told_languages(t: Column) -> Column:
    return F.when(t["languages_implied"], F.array().cast("array<string>")).otherwise(t["languages"])


def _release(t: Column, flags: Column) -> Column:
    return F.struct(
        t["style"].alias("style"), F.lower(t["title"]).alias("title"), t["regions"].alias("regions"), _told_languages(t).alias("languages"), t["status"].alias("status"), flags.alias("flags"), clean_dump_flags(t).alias("dump_flags")
    )


def supersede_key(t: Column) -> Column:
    """All but version and date: releases of one key replace each other."""
    return _release(t, t["flags"])


def set_key(t: Column) -> Column:
    """The same without the disk's flag and a label right behind it: what the disks of one set share."""
    place = t["disk_place"]
    label = F.lower(F.coalesce(F.get(t["flags"], place), F.lit(""))).isin(*DISK_LABELS)
    flags = F.filter(t["flags"], lambda _, i: (i + 1 != place) & ~(label & (i == place)))
    return _release(t, F.when(place > 0, flags).otherwise(t["flags"]))


def archive_identity_key(t: Column) -> Column:
    """An archive's title, state and product flags; chipset, NTSC and memory are variants of one game."""
    product = F.filter(t["flags"], lambda f, i: ~(is_chipset(f) | (F.lower(F.trim(f)) == "ntsc") | (F.get(t["memory"], i) != "")))
    return _identity(t, F.array().cast("array<string>"), "", F.array_sort(F.array_distinct(F.transform(product, spelled))), F.array(F.lower(t["status"])))


def _identity(t: Column, regions: Column, publisher: Column | str, edition: Column, states: Column) -> Column:
    publisher = F.lit(publisher) if isinstance(publisher, str) else publisher
    return F.struct(t["style"].alias("style"), F.lower(t["title"]).alias("title"), regions.alias("regions"), publisher.alias("publisher"), edition.alias("edition"), states.alias("states"))


def identity_key(t: Column) -> Column:
    """One game across versions, years, disks, dumps, languages and chipsets. A dated name's countries,
    publisher, edition and state belong to it; of a region-first name title and regions do."""
    dated, archive = t["style"] == DATED, t["style"] == ARCHIVE
    none = F.array().cast("array<string>")
    place = F.array_position(t["before"], t["publisher"])
    listed = F.filter(t["before"], lambda f, i: ((t["publisher"] == "") | (i + 1 != place)) & (F.get(t["kinds"], i) != "date") & (F.size(F.get(t["rules"], i)) == 0) & ~is_chipset(f))
    product = F.array_sort(F.array_distinct(F.transform(F.filter(t["flags"], lambda f, i: ~(is_chipset(f) | (F.lower(F.trim(f)) == "ntsc") | (F.get(t["memory"], i) != ""))), spelled)))
    states = F.array_sort(F.array_distinct(F.transform(F.filter(t["info"], lambda x: x["rule"].isin(*OTHER_STATES)), lambda x: x["text"])))
    return _identity(t, F.when(archive, none).otherwise(t["regions"]), F.when(dated, F.lower(t["publisher"])).otherwise(""), F.when(dated, listed).when(archive, product).otherwise(none), F.when(dated, states).when(archive, F.array(F.lower(t["status"]))).otherwise(none))


def game_key(t: Column) -> Column:
    """One game across regions, languages, revisions and re-releases; of discs, across the discs as well. Dated
    names and archives have their identity."""
    dated, archive, disc = t["style"] == DATED, t["style"] == ARCHIVE, t["style"] == DISC
    none = F.array().cast("array<string>")
    own = F.filter(t["flags"], lambda f, i: ~F.get(t["kinds"], i).isin(*SAME_GAME) & ~(disc & ((F.get(t["kinds"], i) == "disk") | (F.lower(f) == "rerelease"))))
    edition = F.concat(F.array_sort(F.transform(own, lambda f: F.lower(f))), F.transform(F.array_sort(clean_dump_flags(t)), lambda f: F.concat(F.lit("["), f, F.lit("]"))))
    identity = identity_key(t)
    same = dated | archive
    return F.struct(
        t["style"].alias("style"), F.lower(t["title"]).alias("title"), F.when(same, identity["regions"]).otherwise(none).alias("regions"), F.when(same, identity["publisher"]).otherwise("").alias("publisher"), F.when(same, identity["edition"]).otherwise(edition).alias("edition"),
        F.when(same, identity["states"]).otherwise(F.array(F.lower(t["status"]))).alias("states"),
    )


def title_group(t: Column) -> Column:
    """A title as a user knows it: a dated name's title and publisher, an archive's title, else the game
    without its state."""
    none = F.array().cast("array<string>")
    plain = t["style"].isin(ARCHIVE, DATED)
    return _identity(t, none, F.when(t["style"] == DATED, F.lower(t["publisher"])).otherwise(""), F.when(plain, none).otherwise(game_key(t)["edition"]), none)


def partition_key(t: Column) -> Column:
    """What two disks must share to be in one playlist: told languages and chipset flags."""
    return F.struct(_told_languages(t).alias("languages"), t["chipset"].alias("chipset"))


def edition_text(t: Column) -> Column:
    """The flags of an edition as they are written, without the publisher."""
    return F.array_join(F.transform(without_publisher(t), lambda f: F.concat(F.lit("("), f, F.lit(")"))), "")


def key_text(key: Column) -> Column:
    """A key as text that sorts and compares the same everywhere."""
    return F.to_json(key)
