"""Archive names, ratings and the parts of a selection that registered queries don't reach."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import archives, flags, tags
from shelfmark.operators import changes, library, ratings

ARCHIVES = [
    ("Mole_v2.1-B_De_AGA_1653.lha", "Mole - In the Burrow (Part 1) (German) (Two Disk)", dict(title="Mole - In the Burrow", version="v2.1b", build=1653, languages=["De"], flags=["Part 1", "Two Disk", "AGA"])),
    ("Mole_EnFrDe_Beta2_512k_0417&0500", "", dict(title="Mole_EnFrDe_Beta2_512k_0417&0500", version="", languages=["En", "Fr", "De"], status="Beta", build=500, flags=["512KB"])),
    ("Zap_v1.0_Hack_by_Some_Body_2Disk_1234_NTSC", "Zap (2 Disk)", dict(title="Zap", flags=["2 Disk", "Hack", "NTSC", "by Some_Body_2Disk"], video=["NTSC"], build=1234, languages_implied=True)),
    ("Zap_v1.0_1mb", "Zap (1 MB) (Game Demo 2)", dict(status="Game Demo 2", flags=["1 MB"])),
]


def test_archive_names(spark):
    rows = spark.createDataFrame([(i, s, g) for i, (s, g, _) in enumerate(ARCHIVES)], "i int, stem string, game string")
    got = archives.parse_archive(rows, "stem", "game", "t").orderBy("i").collect()
    for row, (stem, _, want) in zip(got, ARCHIVES, strict=True):
        assert {k: row.t[k] for k in want} == want, stem
    ranks = flags.with_details(archives.parse_archive(rows, "stem", "game", "t"), "t").orderBy("i").collect()
    assert [r.t.memory_rank for r in ranks] == [0, 2, 0, 1] and [r.t.platform_rank for r in ranks] == [1, 2, 2, 2]


SOURCE = """<LaunchBox>
<Game><Name>Café Quest II</Name><ReleaseYear>1991</ReleaseYear><DatabaseID>1</DatabaseID><CommunityRating>4.25</CommunityRating><Platform>P</Platform><CommunityRatingCount>10</CommunityRatingCount></Game>
<Game><Name>Cafe Quest 2</Name><DatabaseID>2</DatabaseID><CommunityRating>1</CommunityRating><Platform>P</Platform><CommunityRatingCount>30</CommunityRatingCount></Game>
<Game><Name>Unrated</Name><DatabaseID>3</DatabaseID><Platform>P</Platform></Game>
<Game><Name>Other Place</Name><DatabaseID>4</DatabaseID><CommunityRating>3</CommunityRating><Platform>Q</Platform><CommunityRatingCount>5</CommunityRatingCount></Game>
<Game><Name>Silver Dragon Warrior Saga</Name><DatabaseID>5</DatabaseID><CommunityRating>2</CommunityRating><Platform>P</Platform><CommunityRatingCount>5</CommunityRatingCount></Game>
<GameAlternateName><AlternateName>Coffee Tale, The</AlternateName><DatabaseID>1</DatabaseID></GameAlternateName>
<GameAlternateName><AlternateName>Cafe Quest 2</AlternateName><DatabaseID>1</DatabaseID></GameAlternateName>
</LaunchBox>"""


def test_ratings_from_their_source(spark, tmp_path):
    (tmp_path / "m.xml").write_text(SOURCE, encoding="utf-8")
    games, names = ratings.read_source(spark, str(tmp_path / "m.xml"))
    index = ratings.build_index(ratings.rated_games(games, ["P"]), names)
    assert {(r.key, r.dbid, r.alt, r.year) for r in index.collect()} == {("cafe quest ii", 1, 0, 1991), ("cafe quest 2", 2, 0, 0), ("coffee tale", 1, 1, 1991), ("silver dragon warrior saga", 5, 0, 0)}
    asked = ["CAFÉ QUEST II", "The Coffee Tale", "Silver Dragen Warrior Saga", "Nothing Here", "x", "Other Place"]
    rows = {r.title: r for r in ratings.look_up(spark.createDataFrame([("P", t) for t in asked], "plat string, title string"), index).collect()}
    assert [(rows[t].kind, rows[t].dbid, rows[t].rating) for t in asked] == [("exact", 1, 8.5), ("alt", 1, 8.5), ("fuzzy", 5, 4.0), (None, None, None), (None, None, None), (None, None, None)]
    # two games read alike with their numerals as digits, so neither is meant
    both = index.where("key = 'cafe quest ii' or key = 'cafe quest 2'").withColumn("key", F.regexp_replace("key", "quest", "quest iii"))
    assert ratings.look_up(spark.createDataFrame([("P", "cafe quest 3 ii")], "plat string, title string"), both).first().kind is None


def test_ratings_are_looked_up_without_a_table_at_the_driver(spark, monkeypatch):
    """Titles made of a number are far larger than the number that sizes are guessed from."""
    from shelfmark.operators import fuzzy

    near = spark.createDataFrame([("P", "zz", "silver dragon 7", 8, 0.95)], "plat string, key string, found string, found_id long, similarity double")
    monkeypatch.setattr(fuzzy, "matches", lambda left, right: near)
    source = spark.range(1000).selectExpr("cast(id + 1 as string) as DatabaseID", "concat('Silver Dragon ', id) as Name", "'P' as Platform", "'4' as CommunityRating", "'9' as CommunityRatingCount", "'1990' as ReleaseYear", "cast(null as string) as ReleaseDate")
    names = spark.range(1000).selectExpr("concat('Amber Castle ', id, ' IV') as AlternateName", "cast(id + 1 as string) as DatabaseID")
    index = ratings.build_index(ratings.rated_games(source, ["P"]), names)
    asked = spark.range(1000).selectExpr("id", "'P' as plat", "case id % 4 when 0 then concat('Silver Dragon ', id) when 1 then concat('Amber Castle ', id, ' IV') when 2 then concat('Amber Castle ', id, ' 4') else 'zz' end as title")
    found = ratings.look_up(asked, index)
    for rows in (index, found):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    kinds = ["exact", "alt", "roman", "fuzzy"]
    assert {(r.id, r.kind, r.dbid) for r in found.collect()} == {(i, kinds[i % 4], 8 if i % 4 == 3 else i + 1) for i in range(1000)}


def test_top_n_keeps_ties_together(spark):
    units = spark.createDataFrame([("a", 9.0, 5, "x", True), ("b", 8.0, 5, "y", True), ("c", 8.0, 5, "Y", True), ("d", 7.0, 9, "z", True), ("e", None, None, "n", True), ("f", 9.5, 9, "half", False)], "game string, rating double, votes int, title string, complete boolean")
    codes = lambda **k: {r.game: r.codes for r in ratings.rating_codes(units, **k).collect() if r.codes}
    assert codes(n=2) == {"d": ["rating_not_top"], "e": ["rating_unrated"]}
    assert codes(least_rating=8.5, keep_unrated=True) == {"b": ["rating_low"], "c": ["rating_low"], "d": ["rating_low"]}
    assert codes(n=10, keep_unrated=True) == {}


def test_only_dump_of_a_version_stays_if_asked(spark):
    names = ["Tool v1 (1990)(Burrow)[m edited]", "Tool v2 (1990)(Burrow)[m edited]", "Tool v2 (1990)(Burrow)", "Tool v3 (1990)(Burrow)[b]"]
    items = library.prepared(tags.parse_dated(spark.createDataFrame([(i, "S", n, "") for i, n in enumerate(names)], "key int, dat string, name string, form string"), "name", "t"))
    for rescue, want in ((False, {2}), (True, {0, 2})):
        chosen = library.select(items, library.Profile(rescue_only_dump=rescue), library.Scope(latest=[], best=[]), styles=(tags.DATED,))
        assert {r.key for r in chosen.where("action = 'keep'").collect()} == want
    with pytest.raises(ValueError):
        library.select(items, library.Profile(top_n=1))


def test_moves_in_a_circle_make_way(spark):
    rows = [(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "d", "e"), (5, "e", "f"), (6, "f", "f"), (7, "G", "h"), (8, "x", "H"), (9, "q", "Q")]
    got = {r.key: r.status for r in changes.resolved(spark.createDataFrame(rows, "key int, source string, target string")).collect()}
    assert got == {1: "move", 2: "move", 3: "move", 4: "conflict", 5: "conflict", 6: "ok", 7: "move", 8: "conflict", 9: "move"}
