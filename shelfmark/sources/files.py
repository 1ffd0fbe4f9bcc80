"""Files as rows: hashes of their content and of its variants, archives, playlists, sheets, journals."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First line of own playlists.
OWN_MARK = "#generated by shelfmark"
HEADER_512, HEADER_16 = 512, 16


def digests(content: Column) -> list[Column]:
    """crc, md5 and sha1 of binary content."""
    return [F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0").alias("crc"), F.md5(content).alias("md5"), F.sha1(content).alias("sha1")]


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, mtime and digests of the files below a folder. Hidden files and files of Spark's
    own (a leading dot or underscore) are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *digests(F.col("content")))


# The first bytes of a headered file, and of files in another byte order.
NES_MAGIC, SWAPPED_MAGIC = "4E45531A", {"swap16": "37804012", "swap32": "40123780"}


def magic(content: Column) -> Column:
    """The first four bytes as hex digits."""
    return F.hex(F.substring(content, 1, 4))


def swapped(content: Column, word: int) -> Column:
    """The bytes of each word of 2 or 4 bytes in the other order; an incomplete word at the end stays."""
    groups = "".join("(..)" for _ in range(word))
    return F.unhex(F.regexp_replace(F.hex(content), groups, "".join(f"${i}" for i in range(word, 0, -1))))


def variants(content: Column, size: Column) -> Column:
    """array of struct(nth, variant, size, sha1): the whole; without a header of 512 bytes, if the size is one of
    whole kilobytes beside it; without one of 16, if the file begins like a headered one; and in the usual byte
    order, if it begins in another one (16-bit words swapped, or 32-bit ones)."""

    def without(n: int) -> Column:
        return F.sha1(F.substring(content, F.lit(n + 1), F.greatest(size.cast("int") - n, F.lit(0))))

    def one(nth: int, name: str, length: Column, sha1: Column) -> Column:
        return F.struct(F.lit(nth).alias("nth"), F.lit(name).alias("variant"), length.cast("bigint").alias("size"), sha1.alias("sha1"))

    whole = one(0, "whole", size, F.sha1(content))
    swaps = [F.when(magic(content) == SWAPPED_MAGIC[name], one(nth, name, size, F.sha1(swapped(content, word)))) for nth, name, word in ((3, "swap16", 2), (4, "swap32", 4))]
    bare = [F.when(size % 1024 == HEADER_512, one(1, "header512", size - HEADER_512, without(HEADER_512))), F.when((size > HEADER_16) & (magic(content) == NES_MAGIC), one(2, "header16", size - HEADER_16, without(HEADER_16)))]
    return F.filter(F.array(whole, *bare, *swaps), lambda v: v.isNotNull())


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.path, batch.content, strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows += [(path, x.filename, x.file_size, f"{x.CRC:08x}", None) for x in archive.infolist() if not x.is_dir()]
            except zipfile.BadZipFile as error:
                rows.append((path, None, None, None, str(error)))
        yield pd.DataFrame(rows, columns=["path", "member", "size", "crc", "error"])


def read_zip_members(spark: SparkSession, folder: str) -> DataFrame:
    """path, member, size and crc from the directories of zip archives; ``error`` for damaged ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder)
    return files.select("path", "content").mapInPandas(_members, "path string, member string, size long, crc string, error string")


def listed_members(listing: Column) -> Column:
    """array of struct(member, size, crc) of a technical listing in blocks of ``Key = value`` lines.

    Blocks are parted by empty lines; folders have no size. An empty checksum of an empty file is 00000000.
    """
    blocks = F.filter(F.split(listing, r"\r?\n\s*\r?\n"), lambda b: b.rlike(r"(?m)^Path = ") & b.rlike(r"(?m)^Size = \d"))

    def value(block: Column, key: str) -> Column:
        return F.regexp_extract(block, rf"(?m)^{key} = ?([^\r\n]*)", 1)

    def row(block: Column) -> Column:
        size, crc = value(block, "Size").try_cast("bigint"), F.lower(value(block, "CRC"))
        return F.struct(value(block, "Path").alias("member"), size.alias("size"), F.when((crc == "") & (size == 0), "00000000").otherwise(crc).alias("crc"))

    return F.transform(blocks, row)


# Archives in which a playlist may name a member behind #.
SELECTED_IN = [".zip", ".7z", ".rar"]


def playlist_lines(texts: DataFrame) -> DataFrame:
    """path, own (whether the first line is the mark), nth, entry, member and label of the lines of ``texts(path, text)``.

    A line is ``entry[#member][|label]``; lines that begin with # are comments. A # parts a member only behind an
    archive's extension, as names may hold one."""
    first = F.get(F.split("text", r"\r?\n"), 0)
    lines = texts.select("path", (first == OWN_MARK).alias("own"), F.posexplode(F.split("text", r"\r?\n")).alias("nth", "line")).withColumn("line", F.trim("line"))
    lines = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    place = F.trim(F.substring_index("line", "|", 1))
    form = "(?i)^(.+?(?:" + "|".join(x.replace(".", "[.]") for x in SELECTED_IN) + "))#(.*)$"
    packed = place.rlike(form)
    label = F.when(F.contains("line", F.lit("|")), F.regexp_extract("line", r"\|(.*)$", 1)).otherwise("")
    return lines.select("path", "own", "nth", F.when(packed, F.regexp_extract(place, form, 1)).otherwise(place).alias("entry"), F.when(packed, F.regexp_extract(place, form, 2)).otherwise("").alias("member"), label.alias("label")).where("entry <> ''")


def read_playlists(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all playlists of a folder (``playlist_lines``)."""
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.m3u")
    return playlist_lines(texts.select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def frames(time: Column) -> Column:
    """Sectors of ``mm:ss:ff``, 75 a second; a single number is frames, missing parts are 0."""
    parts = F.transform(F.split(time, ":"), lambda p: F.coalesce(F.regexp_extract(p, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)))
    get = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(0))
    return F.when(F.size(parts) == 1, get(0)).otherwise((get(0) * 60 + get(1)) * 75 + get(2))


def gdi_tracks(text: Column) -> Column:
    """array of struct(number, lba, type, sector, file) of a GDI sheet, null where the count doesn't fit."""
    lines = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"\r", ""))), lambda x: x != "")
    form = r'^(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(?:"([^"]*)"|(\S+))\s+(\d+)$'
    rows = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(form))

    def track(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x, form, i)
        return F.struct(part(1).try_cast("int").alias("number"), part(2).try_cast("int").alias("lba"), part(3).try_cast("int").alias("type"), part(4).try_cast("int").alias("sector"), F.concat(part(5), part(6)).alias("file"))

    tracks = F.transform(rows, track)
    return F.when(F.get(lines, F.lit(0)).try_cast("int") == F.size(tracks), tracks)


def cue_tracks(text: Column) -> Column:
    """array of struct(file, number, type, start) of a cue sheet; start is that of INDEX 01 in frames."""
    pieces = F.slice(F.split(text, r"(?im)^\s*FILE\s+"), F.lit(2), F.char_length(text) + 1)

    def of_file(piece: Column) -> Column:
        name = F.regexp_extract(piece, r'^(?:"([^"\n]*)"|(\S+))', 0)
        tracks = F.slice(F.split(piece, r"(?im)^\s*TRACK\s+"), F.lit(2), F.char_length(piece) + 1)
        return F.transform(
            tracks,
            lambda t: F.struct(
                F.regexp_replace(name, '^"|"$', "").alias("file"),
                F.regexp_extract(t, r"^(\d+)", 1).try_cast("int").alias("number"),
                F.regexp_extract(t, r"^\d+\s+(\S+)", 1).alias("type"),
                frames(F.regexp_extract(t, r"(?im)^\s*INDEX\s+0?1\s+([\d:]+)", 1)).alias("start"),
            ),
        )

    return F.flatten(F.transform(pieces, of_file))


JOURNAL = "version int, root string, started string, i long, op string, src string, dst string, path string, sha1 string, size long, content string"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Steps of JSON-lines journals that didn't fail: those marked ``failed`` by their number are left out."""
    rows = spark.read.schema(JOURNAL).json(path).withColumn("file", F.input_file_name()).where("i is not null")
    failed = rows.where("op = 'failed'").select("file", "i")
    return rows.where("op not in ('failed', 'end', 'tmp')").join(failed, ["file", "i"], "left_anti")
