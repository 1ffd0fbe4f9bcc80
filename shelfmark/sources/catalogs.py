"""Catalogue files: XML with game/machine and rom elements, and the parenthesised text form."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.names import hex_digest, int_or_zero

ROM = T.StructType([T.StructField(f"_{x}", T.StringType()) for x in ("name", "size", "crc", "md5", "sha1")])
GAME = T.StructType([T.StructField("_name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("category", T.StringType()), T.StructField("rom", T.ArrayType(ROM))])
ROW = "file string, ord long, name string, size long, crc string, md5 string, sha1 string, game string, set_name string, category string"


def kind_of(head: Column) -> Column:
    """xml, text or null by the beginning of a file."""
    text = F.ltrim(F.regexp_replace(F.substring(head, 1, 4096), "^﻿", ""))
    return F.when(text.startswith("<"), "xml").when(text.rlike(r"^(?:clrmamepro|emulator|game|machine)\b"), "text")


# Fixed value: what follows the catalogue's name in the names of dated files.
DATED = r" \(TOSEC-v"


def name_of_file(path: Column) -> Column:
    """Catalogue name of a file name such as ``Name (TOSEC-v2024-01-01_CM).dat``."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), DATED + ".*$", "")


def version_of_file(path: Column) -> Column:
    return F.regexp_extract(path, DATED + "([0-9-]+)", 1)


def newest_files(paths: DataFrame) -> DataFrame:
    """Of files of one catalogue, ``path``, the newest by version and file name."""
    rows = paths.withColumn("dat", name_of_file(F.col("path"))).withColumn("version", version_of_file(F.col("path")))
    return rows.groupBy("dat").agg(F.max(F.struct("version", "path")).alias("m")).select("dat", "m.version", "m.path")


def _clean(rows: DataFrame, roms: Column, sets: bool) -> DataFrame:
    each = rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("game_ord"), F.col("_name").alias("game"), F.coalesce("category", F.lit("")).alias("category"), F.posexplode(roms).alias("rom_ord", "rom"))
    return each.select(
        "file",
        (F.col("game_ord").cast("decimal(20,0)") * 1_000_000_000 + F.col("rom_ord")).alias("ord"),  # game numbers take up to 63 bits
        F.col("rom._name").alias("name"),
        int_or_zero("rom._size").alias("size"),
        *[hex_digest(f"rom._{h}", n).alias(h) for h, n in (("crc", 8), ("md5", 32), ("sha1", 40))],
        "game",
        (F.col("game") if sets else F.lit(None).cast("string")).alias("set_name"),
        "category",
    )


def read_xml(spark: SparkSession, path: str, sets: bool = False) -> DataFrame:
    """Rows of XML catalogues: the roms of all game and machine elements. ``ord`` follows file order.

    With ``sets`` each game is a set (disc catalogues).
    """

    def tag(name: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", name).schema(GAME).load(path)

    return _clean(tag("game").unionByName(tag("machine")), F.col("rom"), sets)


TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([()])|([^\s()"]+)|(")')


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    for m in TOKEN.finditer(text):
        quoted, paren, word, open_quote = m.groups()
        if open_quote:
            raise ValueError(f"open string in line {text.count(chr(10), 0, m.start()) + 1}")
        yield ("(" if paren == "(" else ")", "") if paren else ("word", word if quoted is None else re.sub(r'\\(["\\])', r"\1", quoted))


def _block(tokens: Iterator[tuple[str, str]]) -> list[tuple[str, object]]:
    """Key and value pairs up to the closing parenthesis; values are texts or blocks."""
    out: list[tuple[str, object]] = []
    for kind, key in tokens:
        if kind == ")":
            return out
        kind, value = next(tokens, ("", ""))
        if kind == "(":
            out.append((key, _block(tokens)))
        elif kind == "word":
            out.append((key, value))
        else:
            raise ValueError("unbalanced parenthesis")
    raise ValueError("unbalanced parenthesis")


def _text_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, content in zip(batch.path, batch.content, strict=True):
            try:
                text = bytes(content).decode("utf-8-sig")
            except UnicodeDecodeError:
                text = bytes(content).decode("cp1252", "replace")
            tokens, rows = _tokens(text), []
            for _, word in tokens:
                if next(tokens, ("", ""))[0] != "(":
                    raise ValueError("a block is expected")
                block = _block(tokens)
                if word not in ("game", "machine"):
                    continue
                game = next((v for k, v in block if k == "name"), "")
                for pairs in (v for k, v in block if k == "rom" and isinstance(v, list)):
                    rom = dict(reversed(pairs))  # the first of equal keys counts
                    rows.append((file, len(rows), rom.get("name", ""), rom.get("size", ""), rom.get("crc", ""), rom.get("md5", ""), rom.get("sha1", ""), game, game, ""))
            yield pd.DataFrame(rows, columns=["file", "ord", "name", "size", "crc", "md5", "sha1", "game", "set_name", "category"])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows of text catalogues; each game is a set. An open string or parenthesis is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(_text_rows, ROW.replace("size long", "size string"))
    return rows.select("file", "ord", "name", int_or_zero("size").alias("size"), hex_digest("crc", 8).alias("crc"), hex_digest("md5", 32).alias("md5"), hex_digest("sha1", 40).alias("sha1"), "game", "set_name", "category")
