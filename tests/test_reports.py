"""Reports of a selection: reasons by priority, texts, summaries, totals of disks."""

from pyspark.sql import functions as F

from shelfmark.operators import reports

CHOSEN = "key long, dat string, title_key string, name string, action string, codes array<string>, detail string, t struct<title: string, played: array<string>>"


def rows(spark, *items):
    return spark.createDataFrame([(i, "D", k, n, a, c, d, (n.split(" (")[0], p)) for i, (k, n, a, c, d, p) in enumerate(items)], CHOSEN)


def test_reason_is_the_first_by_priority_of_the_least_blocked(spark):
    chosen = rows(
        spark,
        ("a", "Ant (b)", "excluded", ["bad_dump"], "[b]", ["De"]),
        ("a", "Ant (z)", "excluded", ["language"], "(Fr)", ["Fr", "En"]),
        ("a", "Ant (c)", "excluded", ["rating_low", "demo"], "", []),
        ("b", "Bee", "keep", [], "", ["En"]),
        ("b", "Bee (x)", "excluded", ["demo"], "", ["En"]),
        ("c", "Cat", "incomplete", [], "", ["En"]),
        ("d", "Dog", "excluded", ["rating_low"], "rated 2.0 (9 votes)", ["En"]),
        ("e", "Eel", "excluded", ["other"], "", None),
        ("f", "Fox", "excluded", None, "", []),
    )
    lost = reports.vanished(chosen)
    got = {r.title: (r.name, r.reason, r.codes, r.languages, r.variants, r.detail) for r in lost.collect()}
    assert got == {
        "Ant": ("Ant (b)", "language", ["language", "bad_dump"], ["En", "De", "Fr"], 3, ""),
        "Cat": ("Cat", "incomplete", ["incomplete"], [], 1, ""),
        "Dog": ("Dog", "rating_low", ["rating_low"], [], 1, "rated 2.0 (9 votes)"),
        "Eel": ("Eel", "other", ["other"], [], 1, ""),
        "Fox": ("Fox", "excluded", ["excluded"], [], 1, ""),
    }
    texts = {r.title: (r.text, r.hint) for r in reports.vanish_report(lost).collect()}
    assert texts["Ant"] == ("no version in selected languages (has En, De, Fr)", "") and texts["Dog"] == ("below the minimum rating (rated 2.0 (9 votes))", "lower the minimum rating")
    assert texts["Cat"][0] == "only incomplete sets" and texts["Eel"][0] == "every version excluded: other"
    assert [r.title for r in reports.vanish_report(lost, limit=2).collect()] == ["Ant", "Cat"] and reports.vanish_report(lost, "language").count() == 1
    summary = {(r.kind, r.code): r.n for r in reports.vanish_summary(lost).collect()}
    assert summary[("titles", "")] == 5 and summary[("reason", "language")] == 1 and summary[("code", "bad_dump")] == 1
    assert [tuple(r) for r in reports.vanish_summary(reports.vanished(chosen.limit(0))).collect()] == [("titles", "", 0)]


def test_described(spark):
    info = spark.createDataFrame([([("bad_dump", "[b]"), ("demo", "(Demo)"), ("bad_dump", "[b2]"), ("own", "(x)")],), ([],), (None,)], "i array<struct<rule: string, text: string>>")
    assert [r.x for r in info.select(reports.described("i").alias("x")).collect()] == ["bad dump [b] [b2], demo (Demo), own (x)", "", ""]


def test_ambiguous_bases_and_units(spark):
    names = ["Zap (Disk 1 of 2)[cr X].adf", "Zap (Disk B of C)(Side)[cr X][!]", "Zap (Disk 2 of 2)", "Zap", "Zap (Disk 1 of 1)", "", None]
    got = reports.ambiguous_bases(spark.createDataFrame([("D", n) for n in names], "dat string, name string")).collect()
    assert [(r.dat, r.base, r.totals) for r in got] == [("D", "Zap[cr X]", [2, 3])]
    catalog = spark.createDataFrame([("A", "s", "x"), ("A", "s", "y"), ("A", None, "z"), ("B", "", "x"), ("B", None, "x")], "dat string, set_name string, name string")
    assert sorted(tuple(r) for r in reports.catalogue_units(catalog).collect()) == [("A", "game", 2, 3), ("B", "rom", 1, 2)]
    assert reports.catalogue_units(catalog.limit(0)).count() == 0 and catalog.select(reports.label(F.lit(None).cast("string")).alias("x")).first().x is None
