"""Sheets of discs as state machines: words with quotes, track files, and the layout that follows from area marks.

All is folds over arrays: over the signs of a line, over the lines of a sheet, and over its tracks with a running sum of
sectors. Nothing is read from disk; sizes of files come as a map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a raw sector, and the sector at which the high-density area begins.
SECTOR, HIGH_START = 2352, 45_000
SPACES = [" ", "\t", "\r", "\n", "\v", "\f"]
QUOTES = ['"', "'"]
MARKS = {"sd": "SINGLE-DENSITY AREA", "hd": "HIGH-DENSITY AREA"}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), then), 0)


#: A word: runs of plain signs and of quoted ones; a quote that nothing ends goes on to the end of the line.
WORD = r"""(?:[^ \t\r\n\x0B\f"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))+"""
#: Lines with more quotes are folded sign by sign, as a pattern takes stack for each of them.
MOST_QUOTES = 200


def words(line: Column) -> Column:
    """The words of a line: quotes of either kind group what is inside and are dropped, wherever in a word they stand."""
    runs = F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
    bare = F.transform(runs, lambda w: F.when(F.contains(w, F.lit('"')) | F.contains(w, F.lit("'")), F.regexp_replace(w, r"""(?s)"([^"]*+)(?:"|\z)|'([^']*+)(?:'|\z)""", "$1$2")).otherwise(w))
    quotes = F.char_length(line) - F.char_length(F.translate(line, "\"'", ""))
    return F.when(quotes > MOST_QUOTES, folded_words(line)).otherwise(bare)


def folded_words(line: Column) -> Column:
    """The same as a fold over the signs of the line."""

    def step(s: Column, c: Column) -> Column:
        quote = s["quote"]
        toggles = c.isin(*QUOTES) & ((quote == "") | (quote == c))
        ends = c.isin(*SPACES) & (quote == "")
        done = F.when(ends & s["open"], F.concat(s["done"], F.array(s["word"]))).otherwise(s["done"])
        word = F.when(ends, "").when(toggles, s["word"]).otherwise(F.concat(s["word"], c))
        return F.struct(done.alias("done"), word.alias("word"), (~ends).alias("open"), F.when(toggles, F.when(quote == "", c).otherwise("")).otherwise(quote).alias("quote"))

    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("word"), F.lit(False).alias("open"), F.lit("").alias("quote"))
    signs = F.filter(F.split(line, ""), lambda c: c != "")
    return F.aggregate(signs, begin, step, lambda s: F.when(s["open"], F.concat(s["done"], F.array(s["word"]))).otherwise(s["done"]))


def number(word: Column) -> Column:
    """The whole number a word begins with, else 0."""
    return F.coalesce(F.regexp_extract(word, r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int"), F.lit(0))


def area_mark(line: Column) -> Column:
    """sd or hd for a remark that begins one of the two areas of a disc, else empty."""
    trimmed = F.ltrim(line, F.lit("".join(SPACES)))
    rest = F.ltrim(F.substring(trimmed, 4, F.char_length(trimmed)), F.lit("".join(SPACES)))
    remark = F.startswith(trimmed, F.lit("REM")) & F.substring(trimmed, 4, 1).isin(*SPACES)
    mark = F.lit("")
    for name, text in MARKS.items():
        mark = F.when(remark & F.startswith(rest, F.lit(text)), name).otherwise(mark)
    return mark


def quoted(name: Column) -> Column:
    """A name as one word of a sheet; null if it has quotes of both kinds or a line break."""
    broken = F.contains(name, F.lit("\n")) | F.contains(name, F.lit("\r"))
    return F.when(~broken & ~F.contains(name, F.lit('"')), F.concat(F.lit('"'), name, F.lit('"'))).when(~broken & ~F.contains(name, F.lit("'")), F.concat(F.lit("'"), name, F.lit("'")))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "^﻿", ""), "\n"), lambda x: F.struct(words(x).alias("w"), area_mark(x).alias("mark")))


def gdi_files(text: Column) -> Column:
    """The track files of a GDI sheet in its order; null if a line is short or their number isn't the first line's."""
    lines = F.transform(F.split(F.regexp_replace(text, "^﻿", ""), "\n"), words)
    rows = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda w: F.size(w) > 0)
    good = F.forall(rows, lambda w: (F.size(w) >= 6) & (F.get(w, 4) != ""))
    n = number(F.get(F.split(text, "\n"), 0))
    return F.when(good & (n > 0) & (n == F.size(rows)), F.transform(rows, lambda w: F.get(w, 4)))


def cue_files(text: Column) -> Column:
    """The track files of a cue sheet; null if it names none or a file holds several tracks."""
    lines = F.transform(F.split(F.regexp_replace(text, "^﻿", ""), "\n"), words)
    named = F.filter(lines, lambda w: F.get(w, 0) == "FILE")
    tracks = F.size(F.filter(lines, lambda w: F.get(w, 0) == "TRACK"))
    good = (F.size(named) > 0) & (F.size(named) == tracks) & F.forall(named, lambda w: F.coalesce(F.get(w, 1) != "", F.lit(False)))
    return F.when(good, F.transform(named, lambda w: F.get(w, 1)))


TRACKS = "array<struct<number:int,file:string,audio:boolean,area:string>>"


def cue_layout(text: Column) -> Column:
    """struct(tracks, problem): number, file, audio and area of the tracks of a cue sheet with one track a file.

    The state is the area and the file that wait for their next track; the first problem stays."""

    def step(s: Column, x: Column) -> Column:
        word, mark = F.get(x["w"], 0), x["mark"]
        second, n = F.get(x["w"], 1), number(F.get(x["w"], 1))
        is_file, is_track = (mark == "") & (word == "FILE"), (mark == "") & (word == "TRACK")
        track = F.struct(n.alias("number"), s["file"].alias("file"), F.coalesce(F.get(x["w"], 2) == "AUDIO", F.lit(False)).alias("audio"), s["area"].alias("area"))
        problem = F.when(is_file & (F.coalesce(second, F.lit("")) == ""), "unreadable FILE line").when(is_track & (n <= 0), "unreadable TRACK line").when(is_track & s["file"].isNull(), "several tracks in one file")
        tracks = F.when(F.coalesce(is_track, F.lit(False)), F.concat(s["tracks"], F.array(track))).otherwise(s["tracks"])
        file = F.when(is_file, second).when(F.coalesce(is_track, F.lit(False)), F.lit(None).cast("string")).otherwise(s["file"])
        return F.struct(F.when(mark != "", mark).otherwise(s["area"]).alias("area"), file.alias("file"), tracks.alias("tracks"), F.coalesce(s["problem"], problem).alias("problem"))

    nothing = F.lit(None).cast("string")
    begin = F.struct(F.lit("").alias("area"), nothing.alias("file"), F.array().cast(TRACKS).alias("tracks"), nothing.alias("problem"))
    return _let(F.aggregate(_lines(text), begin, step), _checked)


def _checked(end: Column) -> Column:
    areas = F.transform(end["tracks"], lambda t: t["area"])
    in_order = F.transform(end["tracks"], lambda t: t["number"]) == F.sequence(F.lit(1), F.greatest(F.size(areas), F.lit(1)))
    turned = F.array_contains(areas, "hd") & (F.array_position(areas, "hd") <= F.size(F.filter(areas, lambda a: a == "sd")))
    problem = F.coalesce(
        end["problem"],
        F.when(F.size(areas) == 0, "no tracks"),
        F.when((F.get(areas, 0) != "sd") | F.array_contains(areas, ""), "no marks of its areas"),
        F.when(~in_order, "track numbers are not 1 to n"),
        F.when(turned, "a single-density track behind the high-density area"),
    )
    return F.struct(end["tracks"].alias("tracks"), problem.alias("problem"))


def gdi_of_cue(text: Column, sizes: Column) -> Column:
    """struct(text, problem): the GDI sheet of a cue sheet with area marks; ``sizes`` maps track files to bytes.

    Tracks follow each other from sector 0 on, and the first of the high-density area begins at its own sector."""
    def step(s: Column, t: Column) -> Column:
        size, name = F.try_element_at(sizes, t["file"]), quoted(t["file"])
        enters = (t["area"] == "hd") & ~s["high"]
        at = F.when(enters, HIGH_START).otherwise(s["at"])
        problem = F.when(size.isNull(), F.concat(F.lit("track file missing: "), t["file"])).when((size == 0) | (size % SECTOR != 0), F.concat(t["file"], F.lit(" is no whole number of sectors"))).when(enters & (s["at"] > HIGH_START), "the single-density tracks are too long").when(name.isNull(), F.concat(t["file"], F.lit(" has quotes of both kinds")))
        line = F.concat_ws(" ", t["number"].cast("string"), at.cast("string"), F.when(t["audio"], "0").otherwise("4"), F.lit(str(SECTOR)), name, F.lit("0"))
        after = (at + F.floor(F.coalesce(size, F.lit(0)) / SECTOR)).cast("long")
        return F.struct(after.alias("at"), (s["high"] | enters).alias("high"), F.concat(s["lines"], F.array(line)).alias("lines"), F.coalesce(s["problem"], problem).alias("problem"))

    def laid_out(layout: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("high"), F.array(F.size(layout["tracks"]).cast("string")).alias("lines"), layout["problem"].alias("problem"))
        return F.aggregate(layout["tracks"], begin, step, lambda end: F.struct(F.when(end["problem"].isNull(), F.concat(F.array_join(end["lines"], "\n"), F.lit("\n"))).alias("text"), end["problem"].alias("problem")))

    return _let(cue_layout(text), laid_out)
