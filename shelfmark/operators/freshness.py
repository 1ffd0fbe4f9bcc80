"""Whether catalogues and indexes at hand are up to date: what is installed beside what servers told.

Answers of servers are rows, ``remote(dat, status, error, ...)``: the HTTP status, or null and the error of a request that
failed. Requests are made elsewhere, all at once or one by one. A name has at most one row in each table; a name without an
answer is ``unknown``. Nulls in any column count as not told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a catalogue or index.
CURRENT, UPDATE, MISSING, UNKNOWN, ERROR = "up_to_date", "update_available", "missing", "unknown", "error"
# Fixed value: an index younger than so many days is not asked about.
REFRESH_DAYS = 7


def _told(value: Column | str) -> Column:
    """The text without spaces around it; null where there is none."""
    return F.nullif(F.trim(value), F.lit(""))


def entity_tag(value: Column | str) -> Column:
    """An ETag as compared: weak ones as strong ones; null without one."""
    tag = F.trim(value)
    return _told(F.when(F.startswith(tag, F.lit("W/")), F.substring(tag, F.lit(3), F.char_length(tag))).otherwise(tag))


def http_time(value: Column | str) -> Column:
    """Seconds since 1970 of ``Wed, 21 Oct 2015 07:28:00 GMT``; null for other texts."""
    day_on = F.trim(F.substring_index(value, ",", -1))
    return F.unix_timestamp(F.try_to_timestamp(day_on, F.lit("d MMM yyyy HH:mm:ss z")))


def iso_time(value: Column | str) -> Column:
    """Seconds since 1970 of ``2024-01-31T10:00:00`` and what may follow, in UTC; 0 for other texts."""
    text = F.concat(F.substring(value, 1, 19), F.lit("Z"))
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))), F.lit(0))


def file_told(disposition: Column | str) -> Column:
    """struct(file, version) of a Content-Disposition header; nulls where it tells none.

    The version is the last time in round signs, ``(2024-01-31 10-00-00)``, of the file's name."""
    column = F.col(disposition) if isinstance(disposition, str) else disposition
    parts = F.transform(F.split(column, ";"), lambda p: F.trim(p))
    named = F.get(F.filter(parts, lambda p: F.rtrim(F.substring_index(F.lower(p), "=", 1)).isin("filename", "filename*")), 0)
    value = F.substring(named, F.char_length(F.substring_index(named, "=", 1)) + 2, F.char_length(named))
    value = F.when(F.startswith(F.lower(value), F.lit("utf-8''")), F.substring(value, F.lit(8), F.char_length(value))).otherwise(value)
    file = _told(F.replace(value, F.lit('"'), F.lit("")))
    times = F.filter(F.split(file, "[()]"), lambda x: F.translate(x, "123456789", "000000000") == "0000-00-00 00-00-00")
    return F.struct(file.alias("file"), F.try_element_at(times, F.lit(-1)).alias("version"))


def _failed() -> Column:
    return F.coalesce(_told("error"), F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))))


def _beside(names: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Names with their version at hand (``there``: whether there is a file) and the answer (``asked``)."""
    here = local.select("dat", _told("version").alias("installed"), F.lit(True).alias("there"))
    answers = remote.withColumn("asked", F.lit(True))
    return names.select("dat").distinct().join(here, "dat", "left").join(answers, "dat", "left")


def _state(current: Column, comparable: Column) -> Column:
    """The state of a name, what decides first standing first."""
    return F.when(_failed().isNotNull(), ERROR).when(F.col("asked").isNull(), UNKNOWN).when(F.col("there").isNull(), MISSING).when(~comparable, UNKNOWN).when(current, CURRENT).otherwise(UPDATE)


def by_tag(names: DataFrame, local: DataFrame, manifest: DataFrame, remote: DataFrame) -> DataFrame:
    """dat, installed, status, error of catalogues without versions: the tag of their last download, ``manifest(dat, etag)``,
    beside ``remote(dat, status, etag, error)``. A file without a known tag is unknown, and so fetched again."""
    rows = _beside(names, local, remote).join(manifest.select("dat", entity_tag("etag").alias("_stored")), "dat", "left")
    rows = rows.withColumn("_tag", entity_tag("etag"))
    both = F.col("_stored").isNotNull() & F.col("_tag").isNotNull()
    return rows.select("dat", "installed", _state(F.col("_stored") == F.col("_tag"), both).alias("status"), _failed().alias("error"))


def by_version(names: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """dat, installed, latest, status, error of catalogues whose version ``remote(dat, status, disposition, error)`` tells in a
    file's name. Versions are times that compare as texts; a file without one is older than any."""
    rows = _beside(names, local, remote).withColumn("latest", F.when(_failed().isNull(), file_told("disposition")["version"]))
    current = F.coalesce(F.col("installed") >= F.col("latest"), F.lit(False))
    return rows.select("dat", "installed", "latest", _state(current, F.col("latest").isNotNull()).alias("status"), _failed().alias("error"))


def to_fetch(states: DataFrame) -> DataFrame:
    """The names to download: those that are missing, have an update, or can't be told."""
    return states.where(F.col("status").isin(MISSING, UPDATE, UNKNOWN))


def usable(manifests: DataFrame, indexes: DataFrame, schema: int) -> DataFrame:
    """Manifests of this schema whose index, ``indexes(dat)``, is there."""
    return manifests.where(F.col("schema") == schema).join(indexes.select("dat"), "dat", "left_semi")


def index_states(names: DataFrame, manifests: DataFrame, remote: DataFrame, now: Column | int, days: float | None = REFRESH_DAYS) -> DataFrame:
    """dat, installed (date of its source), age_days, latest, status, error of indexes.

    ``manifests(dat, built_at, etag, last_modified)`` are the usable ones, ``remote(dat, status, etag, last_modified, error)``
    the answers, ``now`` seconds since 1970. An index younger than ``days`` is up to date whatever was answered (None: all are
    asked about). Two dates decide by which is later, else another tag or another date means newer data."""
    here = manifests.select("dat", "built_at", entity_tag("etag").alias("_tag"), _told("last_modified").alias("_modified"), F.lit(True).alias("there"))
    asked = remote.select("dat", "status", "error", entity_tag("etag").alias("_new_tag"), _told("last_modified").alias("_new_modified"), F.lit(True).alias("asked"))
    rows = names.select("dat").distinct().join(here, "dat", "left").join(asked, "dat", "left")
    built, then, later = iso_time("built_at"), http_time("_modified"), http_time("_new_modified")
    seconds = F.lit(now) if isinstance(now, int) else now
    rows = rows.withColumn("age_days", F.when(built != 0, (seconds - built) / 86400.0))
    other = lambda new, old: F.col(new).isNotNull() & ~F.col(new).eqNullSafe(F.col(old))
    newer = F.when(then.isNotNull() & later.isNotNull(), later > then).otherwise(other("_new_tag", "_tag") | other("_new_modified", "_modified"))
    young = F.coalesce(F.col("there") & (F.col("age_days") < days), F.lit(False)) if days is not None else F.lit(False)
    status = F.when(young, CURRENT).when(_failed().isNotNull(), ERROR).when(F.col("there").isNull(), MISSING).when(F.col("asked").isNull(), UNKNOWN).when(newer, UPDATE).otherwise(CURRENT)
    source = F.coalesce(F.date_format(F.timestamp_seconds(then), "yyyy-MM-dd"), _told(F.substring("built_at", 1, 10)))
    shown = ~young & _failed().isNull()
    return rows.select("dat", source.alias("installed"), "age_days", F.when(shown, F.col("_new_modified")).alias("latest"), status.alias("status"), F.when(~young, _failed()).alias("error"))


def installed_release(releases: DataFrame, files: DataFrame) -> DataFrame:
    """``releases(folder, release)`` of the folders that hold a catalogue, of ``files(path)``; empty releases are none."""
    folders = files.where(F.lower("path").endswith(".dat")).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    return releases.where(_told("release").isNotNull()).join(folders, "folder", "left_semi")


def in_order(platforms: DataFrame, listing: DataFrame) -> DataFrame:
    """platform, dat, priority, path, missing of ``platforms(platform, dats)``: a list of catalogues is its order of priority,
    from 0. Of a name listed twice the first place counts; empty names are left out."""
    each = platforms.select("platform", F.posexplode("dats").alias("place", "dat")).where(_told("dat").isNotNull())
    first = each.groupBy("platform", "dat").agg(F.min("place").alias("place"))
    joined = first.join(listing.select("dat", "path"), "dat", "left")
    # places are numbered again, as names may have been left out; a list is as long as a platform's catalogues
    rank = F.array_position(F.col("_places"), F.col("place")) - 1
    places = first.groupBy("platform").agg(F.array_sort(F.collect_list("place")).alias("_places"))
    return joined.join(places, "platform").select("platform", "dat", rank.cast("int").alias("priority"), "path", F.col("path").isNull().alias("missing"))
