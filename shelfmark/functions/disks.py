"""Disks of a set: names without their disk, and which dump flags of one disk fit another's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip_ext
from .tags import is_date

# Codes of flags that tell a dump apart, and words that mark another build.
DUMP_CODES = ["cr", "f", "h", "m", "p", "t", "tr", "o", "u", "v", "b", "a"]
BUILD_WORDS = ["beta", "alpha", "proto", "prototype", "preview", "pre-release", "demo", "compilation"]
VERIFIED = "!"


def _code(flag: Column) -> Column:
    """cr of "cr2 SR": the first word without its number."""
    return F.rtrim(F.get(F.split(flag, " "), 0), F.lit("0123456789"))


def is_neutral(flag: Column) -> Column:
    """Dump flags (without brackets) that make no other variant of a disk: neither a dump code nor a build."""
    low = F.lower(flag)
    begins = [F.startswith(low, F.lit(w)) & ~F.substring(low, len(w) + 1, 1).rlike(r"\w") for w in BUILD_WORDS]
    build = F.endswith(low, F.lit("version"))
    for b in begins:
        build = build | b
    return ~(_code(flag).isin(*DUMP_CODES) | build)


def generalises(flag: Column, other: Column) -> Column:
    """Whether ``flag`` is a shorter form of ``other``: its beginning up to a space, or its bare code, as
    [cr] and [cr2] are of [cr SR]. [a] and [a2] are different alternates."""
    bare = ~F.contains(flag, F.lit(" ")) & F.contains(other, F.lit(" ")) & (_code(flag) == _code(other))
    return (flag != other) & (F.startswith(other, F.concat(flag, F.lit(" "))) | bare)


def fit(flags: Column, wanted: Column) -> Column:
    """struct(general, verified, shared, neutral) of a disk with ``flags`` in a set with ``wanted`` ones; the smaller, the
    better. Null if it carries a flag that is neither wanted, a shorter form of one, nor neutral."""
    more = F.array_except(flags, wanted)
    neutral = F.size(F.filter(more, is_neutral))
    general = F.size(F.filter(more, lambda f: ~is_neutral(f) & F.exists(wanted, lambda w: generalises(f, w))))
    verified = F.when(F.array_contains(flags, VERIFIED), 0).otherwise(1)
    rank = F.struct(general.alias("general"), verified.alias("verified"), (-F.size(F.array_intersect(flags, wanted))).alias("shared"), neutral.alias("neutral"))
    return F.when(general + neutral == F.size(more), rank)


def _before_disk(stem: Column, disk_flag: Column) -> Column:
    place = F.position(F.concat(F.lit("("), disk_flag, F.lit(")")), stem)
    return F.when(place > 0, F.left(stem, place - 1)).otherwise(stem)


def set_title(name: Column, disk_flag: Column) -> Column:
    """A disk's name without its disk, the labels right behind it, and its dump flags."""
    stem = strip_ext(name)
    before = _before_disk(stem, disk_flag)
    after = F.substring(stem, F.char_length(before) + F.char_length(disk_flag) + 3, F.char_length(stem))
    rest = F.regexp_replace(F.regexp_replace(after, r"^(?:\([^()]*\))+", ""), r"\[[^\[\]]*\]", "")
    return F.trim(F.concat(F.rtrim(before), rest))


def flag_text(flags: Column) -> Column:
    return F.array_join(F.transform(flags, lambda f: F.concat(F.lit("["), f, F.lit("]"))), "")


def edition(name: Column, disk_flag: Column, publisher: Column) -> Column:
    """The round groups of a name before its disk, as written, without dates and the publisher: (DE), (de)(M3)."""
    groups = F.regexp_extract_all(_before_disk(strip_ext(name), disk_flag), F.lit(r"\(([^()]*)\)"))
    kept = F.filter(groups, lambda g: ~is_date(g))
    kept = F.when((publisher != "") & (F.get(kept, 0) == publisher), F.slice(kept, 2, F.size(kept))).otherwise(kept)
    return F.array_join(F.transform(kept, lambda g: F.concat(F.lit("("), g, F.lit(")"))), "")
