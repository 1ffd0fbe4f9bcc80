"""Catalogue freshness: headers, states, and what nulls and empty tables give."""

from pyspark.sql import functions as F

from shelfmark.operators import freshness as fresh


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_headers(spark):
    lit = F.lit
    assert one(spark, fresh.entity_tag(lit(' W/"ab" '))) == '"ab"' and one(spark, fresh.entity_tag(lit(" "))) is None and one(spark, fresh.entity_tag(lit(None).cast("string"))) is None
    assert one(spark, fresh.http_time(lit("Wed, 21 Oct 2015 07:28:00 GMT"))) == 1445412480 and one(spark, fresh.http_time(lit("yesterday"))) is None
    assert one(spark, fresh.iso_time(lit("1970-01-02T00:00:01.5+02:00"))) == 86401 and one(spark, fresh.iso_time(lit("2024"))) == 0 and one(spark, fresh.iso_time(lit(None).cast("string"))) == 0
    told = [
        ('attachment; filename="A (2024-01-02 03-04-05).zip"', ("A (2024-01-02 03-04-05).zip", "2024-01-02 03-04-05")),
        ("attachment; size=3; FILENAME*=UTF-8''b (1) (2024-01-02 03-04-05) (2025-01-02 03-04-05).zip", ("b (1) (2024-01-02 03-04-05) (2025-01-02 03-04-05).zip", "2025-01-02 03-04-05")),
        ("attachment; filename=x (2024-01-02).dat", ("x (2024-01-02).dat", None)),
        ("inline", (None, None)),
        ("", (None, None)),
        (None, (None, None)),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(told)], "i int, h string").withColumn("t", fresh.file_told("h")).orderBy("i").collect()
    assert [tuple(r.t) for r in rows] == [w for _, w in told]


def test_states_without_rows_or_values(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "dat string")
    local = spark.createDataFrame([("a", None), ("b", "2")], "dat string, version string")
    tags = spark.createDataFrame([("a", None), ("b", 'W/"1"')], "dat string, etag string")
    remote = spark.createDataFrame([("a", 200, '"1"', None), ("b", None, '"1"', " "), ("c", 200, None, None)], "dat string, status int, etag string, error string")
    got = {r.dat: (r.installed, r.status, r.error) for r in fresh.by_tag(names, local, tags, remote).collect()}
    assert got == {"a": (None, "unknown", None), "b": ("2", "up_to_date", None), "c": (None, "missing", None)}
    assert {r.status for r in fresh.by_tag(names, local, tags, remote.limit(0)).collect()} == {"unknown"}
    assert fresh.by_tag(names.limit(0), local, tags, remote).count() == 0
    states = fresh.by_tag(names, local, tags, remote)
    assert {r.dat for r in fresh.to_fetch(states).collect()} == {"a", "c"}


def test_index_states(spark):
    day, now = 86400, 100 * 86400
    names = spark.createDataFrame([(x,) for x in "abcdefg"], "dat string")
    old, young = "1970-01-02T00:00:00", "1970-04-10T00:00:00"
    manifests = spark.createDataFrame([("a", 1, young, "1", None), ("b", 1, old, "1", None), ("c", 1, old, "1", "Fri, 02 Jan 1970 00:00:00 GMT"), ("d", 2, old, "1", None), ("e", 1, "?", "1", "x"), ("g", 1, old, "1", None)], "dat string, schema int, built_at string, etag string, last_modified string")
    indexes = spark.createDataFrame([(x,) for x in "abcdeg"], "dat string")
    here = fresh.usable(manifests, indexes, 1)
    answers = [("a", 500, "2", None, None), ("b", 200, "2", None, None), ("c", 200, "2", "Thu, 01 Jan 1970 00:00:00 GMT", None), ("d", 200, "1", None, None), ("e", 200, "1", "x", None), ("f", None, None, None, "timed out")]
    remote = spark.createDataFrame(answers, "dat string, status int, etag string, last_modified string, error string")
    got = {r.dat: r for r in fresh.index_states(names, here, remote, now).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "up_to_date", "b": "update_available", "c": "up_to_date", "d": "missing", "e": "up_to_date", "f": "error", "g": "unknown"}
    assert got["a"].error is None and got["f"].error == "timed out" and got["b"].age_days == (now - day) / day and got["e"].age_days is None
    assert got["c"].installed == "1970-01-02" and got["b"].installed == "1970-01-02" and got["d"].installed is None
    asked = {r.dat: r.status for r in fresh.index_states(names, here, remote, F.lit(now), None).collect()}
    assert asked["a"] == "error"


def test_releases_and_order(spark):
    releases = spark.createDataFrame([("/d", "2024-01-01"), ("/e", "2024-01-01"), ("/f", "")], "folder string, release string")
    files = spark.createDataFrame([("/d/x.DAT",), ("/e/x.txt",), ("/f/y.dat",), ("/d/z.dat",)], "path string")
    assert [tuple(r) for r in fresh.installed_release(releases, files).collect()] == [("/d", "2024-01-01")]
    platforms = spark.createDataFrame([("p", ["b", "", "a", "b", None, "c"]), ("q", []), ("r", None)], "platform string, dats array<string>")
    listing = spark.createDataFrame([("a", "/a"), ("b", "/b")], "dat string, path string")
    rows = sorted(tuple(r) for r in fresh.in_order(platforms, listing).collect())
    assert rows == [("p", "a", 1, "/a", False), ("p", "b", 0, "/b", False), ("p", "c", 2, None, True)]
