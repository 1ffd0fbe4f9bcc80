"""Where files belong: folders that set files aside, target names, and whether a file is in its place.

Paths are relative to the root, with / between parts; a path of one part is a file at the top.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import safe_filename
from .tags import _map

# Folders the rules send files to, all reserved ones (in any case), and protected ones.
UNMATCHED, CONVERTED = "_unmatched", "_converted_originals"
REASONS = {"excluded": "_excluded", "superseded": "_superseded", "incomplete": "_incomplete", "duplicate": "_duplicates"}
RESERVED = [UNMATCHED, *REASONS.values(), CONVERTED]
PROTECTED = ["Kickstarts"]
# Extensions of variants, of files that can be converted, and of files without their header.
HEADERED = {".sfc": ".smc", ".unh": ".nes"}
SWAPPED = {"v64": ".v64", "n64": ".n64"}
CONVERTIBLE, RAW_SWAPPED, HEADERLESS = [".sfc", ".z64"], [".v64", ".n64"], [".unh"]
NAME_BYTES = 255


def shown(path: Column, member: Column) -> Column:
    """The path, with the member behind :: for a file in an archive."""
    return F.when(member.isNull(), path).otherwise(F.concat_ws("::", path, member))


def split_extension(name: Column) -> tuple[Column, Column]:
    """A name and its last extension with the dot; names that begin with their only dot, or end with it, have none."""
    extension = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.left(name, F.char_length(name) - F.char_length(extension)), extension


# ---- folders


def _part(path: Column, n: int) -> Column:
    return F.lower(F.coalesce(F.get(F.split(path, "/"), n), F.lit("")))


def _depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def top_folder(path: Column) -> Column:
    """The reserved top folder a file is in, in its usual spelling; null for others and for files at the top."""
    return F.when((_depth(path) > 1) & _part(path, 0).isin(*RESERVED), _part(path, 0))


def is_legacy(path: Column) -> Column:
    """In a reserved folder inside of _unmatched, where they used to be."""
    return (_depth(path) > 2) & (_part(path, 0) == UNMATCHED) & _part(path, 1).isin(*RESERVED[1:])


def reserved_folder(path: Column) -> Column:
    return F.when(is_legacy(path), _part(path, 1)).otherwise(top_folder(path))


def is_set_aside(path: Column) -> Column:
    """In a folder that a rule or the check for duplicates sends files to."""
    return F.coalesce(reserved_folder(path).isin(*REASONS.values()), F.lit(False))


def is_set_aside_duplicate(path: Column) -> Column:
    return F.coalesce(reserved_folder(path) == REASONS["duplicate"], F.lit(False))


def is_converted_original(path: Column) -> Column:
    return F.coalesce(reserved_folder(path) == CONVERTED, F.lit(False))


def is_protected(path: Column, names: list[str] | None = None) -> Column:
    return (_depth(path) > 1) & _part(path, 0).isin(*[x.lower() for x in (PROTECTED if names is None else names)])


def core_path(path: Column) -> Column:
    """The path without its reserved folders."""
    parts = F.split(path, "/")
    taken = F.when(is_legacy(path), 2).when(top_folder(path).isNotNull(), 1).otherwise(0)
    return F.array_join(F.slice(parts, taken + 1, F.size(parts)), "/")


def reason_destination(path: Column, reason: Column) -> Column:
    """Where a file of a reason (excluded, superseded, incomplete, duplicate) goes; its place in the tree stays."""
    return F.concat_ws("/", F.try_element_at(_map(REASONS), reason), core_path(path))


# ---- names


def limited_name(name: Column) -> Column:
    """A safe name of at most NAME_BYTES bytes in UTF-8, cut before its extension; an extension of half of that
    and more is no extension."""
    safe = safe_filename(name)
    stem, extension = split_extension(safe)
    whole = F.octet_length(extension) >= NAME_BYTES // 2
    stem, extension = F.when(whole, safe).otherwise(stem), F.when(whole, "").otherwise(extension)
    room = F.lit(NAME_BYTES) - F.octet_length(extension)
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(stem.cast("binary"), F.lit(1), room).cast("string")), "[�. ]+$", "")
    return F.when(F.octet_length(safe) <= NAME_BYTES, safe).otherwise(F.concat(F.when(cut == "", "_").otherwise(cut), extension))


def archive_stem(set_name: Column, game: Column) -> Column:
    return F.coalesce(F.nullif(set_name, F.lit("")), game)


def target_name(rom: Column, set_name: Column, game: Column, source: Column, via: Column, order: Column, archive: Column) -> Column:
    """The name of a file that matches a rom: an archive's stem; the rom's name for a raw match; else its set or stem
    with the extension of what the file is (its byte order, its container, a header). ``archive`` is null for a file
    that is none, else the archive's extension."""
    rom_stem, rom_extension = split_extension(rom)
    _, own = split_extension(source)
    stem = F.coalesce(F.nullif(set_name, F.lit("")), rom_stem)
    same = (own == "") | (F.lower(own) == F.lower(rom_extension))
    extension = (
        F.when(via == "container", F.when(own != "", own).otherwise(rom_extension))
        .when(via == "byteswapped", F.coalesce(F.try_element_at(_map(SWAPPED), order), F.nullif(own, F.lit("")), rom_extension))
        .when(same, F.coalesce(F.try_element_at(_map(HEADERED), F.lower(rom_extension)), rom_extension))
        .otherwise(own)
    )
    plain = F.when(archive.isNotNull(), F.concat(archive_stem(set_name, game), archive)).when(via.isin("", "raw"), rom).otherwise(F.concat(stem, extension))
    return limited_name(plain)


def canonical_folder(dat: Column, flat: Column | bool = False) -> Column:
    flat = F.lit(flat) if isinstance(flat, bool) else flat
    return F.when(flat, "").otherwise(limited_name(dat))


def header_form(rom: Column, via: Column) -> Column:
    """headerless for a raw match of a dump without its header; versions are compared within one form."""
    return F.when((via == "raw") & F.lower(split_extension(rom)[1]).isin(*HEADERLESS), "headerless").otherwise("")


def is_convertible(rom: Column, via: Column) -> Column:
    """Another variant of a clean file, or a raw match of a byte-swapped one."""
    extension = F.lower(split_extension(rom)[1])
    return F.when(via == "raw", extension.isin(*RAW_SWAPPED)).otherwise(extension.isin(*CONVERTIBLE))


def is_named(name: Column, target: Column, rom: Column, via: Column, stem: Column, members: Column) -> Column:
    """Whether a file has one of its names; ``members`` is null for a loose file, and an archive of several has none."""
    loose = (name == target) | ((via == "raw") & (name == rom))
    return F.when(members.isNull(), loose).otherwise((members == 1) & ((split_extension(name)[0] == stem) | (name == target)))


def is_placed(path: Column, folder: Column, name: Column) -> Column:
    """Whether a file is at the folder and has the name; an empty folder is the top."""
    return path == F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))
