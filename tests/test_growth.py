"""Steps that must not grow faster than their input: the same results by other means, and what is computed once."""

import random

from pyspark.sql import functions as F

from shelfmark.functions import sheets, tags
from shelfmark.operators import changes, discs, slots


def test_words_by_pattern_equal_those_by_signs(spark):
    r = random.Random(5)
    lines = ["".join(r.choice("ab\"' \t\r\n\x0b\x0c$\\é😀") for _ in range(r.randint(0, 14))) for _ in range(2000)] + ["", '""', "a\"b c'd\"e", "'x", '"' * 500 + " a", None]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(sheets.words(F.col("line")).alias("a"), sheets.folded_words(F.col("line")).alias("b"))
    assert rows.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert "regexp_extract_all" in rows.select("a")._jdf.queryExecution().analyzed().toString()


def test_titles_with_versions(spark):
    """Titles end with versions of one, two or three words; what is asked of a word stands once in the plan."""
    want = {
        "Game v1.2": ("Game", "v1.2", ""), "Game v1.2aAB": ("Game", "v1.2a", "AB"), "Game Rev 2": ("Game", "Rev 2", ""), "Game v1.3 rev1": ("Game", "v1.3 rev1", ""), "Game v1.3 rev 1": ("Game", "v1.3 rev 1", ""), "Game r12X": ("Game", "r12", "X"), "Game v1.0r2": ("Game", "v1.0r2", ""),
        "v1.2": ("v1.2", "", ""), "Game": ("Game", "", ""), "": ("", "", ""), "Game v1.x": ("Game v1.x", "", ""), "Game  two v2": ("Game  two", "v2", ""),
    }
    df = tags._steps(spark.createDataFrame([(t,) for t in want], "title string"), *tags.title_version_steps(F.col("title")))
    assert {r.title: tuple(r._cut) for r in df.collect()} == want
    plan = df.select("_cut")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("([A-Z]{1,3})$") == 1


def test_system_files_join_each_content_once(spark):
    """Many files of one name and content are one row of the join."""
    wanted = spark.createDataFrame([("a.rom", "m"), ("b.rom", "m"), ("c.rom", "n")], "filename string, md5 string")
    files = spark.range(3000).selectExpr("concat('d/', lpad(cast(id as string), 4, '0')) as path", "if(id % 2 = 0, 'A.ROM', 'x') as name", "'m' as md5")
    found = discs.system_files(wanted, files)
    assert sorted(map(tuple, found.collect())) == [("a.rom", "ok", "d/0000"), ("b.rom", "copy", "d/0000"), ("c.rom", "missing", None)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_groupingexpression" in text


def test_playlists_are_numbered_in_blocks(spark):
    """Equal names of a folder are numbered by set through several blocks; no window orders all sets of a name."""
    rows = spark.range(0, 500, 1, 6).selectExpr("id as set", "concat(if(id % 2 = 0, 'Set', 'SET'), cast(id % 3 as string)) as name", "1 as slot", "concat('games/d', cast(id as string), '.adf') as file", "cast(null as string) as member", "cast(null as int) as members", "cast(null as string) as label")
    found = {r.set: r.path for r in changes.playlists(rows).collect()}
    want, n = {}, {}
    for i in range(500):
        n[i % 3] = n.get(i % 3, 0) + 1
        want[i] = f"games/{'Set' if i % 2 == 0 else 'SET'}{i % 3}{f' ({n[i % 3]})' if n[i % 3] > 1 else ''}.m3u"
    assert found == want
    plan = changes.playlists(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan


def test_names_of_a_file_of_one_row_group_are_read_by_all_tasks(spark, tmp_path):
    from shelfmark.plans import library, serving

    part = spark.range(40).selectExpr("id as p_partkey", "'red ring' as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "cast(id % 50 as int) as p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).selectExpr("id as o_orderkey", "id as o_custkey", "date'2020-01-01' as o_orderdate", "'O' as o_orderstatus").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (library.QUERIES["dated_keys"](spark, str(tmp_path)), library._part(spark, str(tmp_path), title="p_name"), serving.QUERIES["tag_parse_dated"](spark, str(tmp_path))):
        assert rows.rdd.getNumPartitions() == n and rows.count() == 40


PARTS = "identity string, slot int, total int, version array<int>, flags array<string>, key string"


def test_slots_make_no_pairs_of_disks(spark):
    """No step makes a row for each pair of an anchor and a disk, and small rows are still dealt out to all tasks."""
    rows = [("g", slot, 2, [i % 90], [], f"{slot}-{i:03}") for slot in (1, 2) for i in range(400)]
    made = {}

    def walk(node):
        if node.metrics().contains("numOutputRows"):
            made[node.nodeName()] = max(made.get(node.nodeName(), 0), node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    parts = spark.createDataFrame(rows, PARTS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = slots.filled(parts)
        got = {(r.anchor, r.slot): r.key for r in found.collect()}
        walk(found._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {(f"1-{i:03}", slot): f"{slot}-{i if slot == 1 else i % 90:03}" for slot in (1, 2) for i in range(400)}
    assert made and max(made.values()) <= 3 * 400, made
    assert slots.filled(parts).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_slots_equal_those_by_pairs(spark):
    """Random disks, some of them without an identity, total, version, flags or key and some listed twice, against all pairs."""
    r = random.Random(12)
    maybe = lambda x: None if r.random() < 0.04 else x
    rows = [(maybe(r.choice("ab")), maybe(r.randint(0, 4)), maybe(r.choice([1, 3, 3])), maybe([r.randint(1, 3), maybe(r.randint(0, 2))]), maybe(r.sample(["x", "y", "z"], r.choice([0, 0, 1, 2]))), maybe(f"k{i:03}")) for i in range(150)]
    want, low = {}, lambda v: [(x is not None, x or 0) for x in v]
    for identity, slot, total, version, flags, anchor in rows:
        for at in range(1, max(total or 1, 1) + 1) if slot == 1 else ():
            fit = [(version2, len(flags2), key) for i2, s2, t2, version2, flags2, key in rows if None not in (identity, total, version, flags, version2, flags2) and (i2, s2, t2) == (identity, at, total) and low(version2) <= low(version) and set(flags) <= set(flags2) and (at > 1 or key is not None and key == anchor)]
            want.setdefault((identity, anchor, at), []).extend(fit)
    rank = lambda d: ([(-known, -x) for known, x in low(d[0])], d[1], d[2] is None, d[2] or "")
    want = {k: min(v, key=rank)[2] if v else None for k, v in want.items()}
    found = slots.filled(spark.createDataFrame(rows + rows[:40], PARTS)).collect()
    assert {(x.identity, x.anchor, x.slot): x.key for x in found} == want and len(found) == len(want)
    assert len({v for v in want.values()}) > 20


def test_lines_with_gaps_fill_slots_as_in_sql(spark, tmp_path):
    import duckdb

    from shelfmark.plans import serving

    r = random.Random(3)
    maybe = lambda x: None if r.random() < 0.05 else x
    lines = [(maybe(r.randint(1, 60)), maybe(r.randint(1, 4)), maybe(r.randint(1, 9)), maybe(r.randint(1, 7)), maybe(float(r.randint(1, 12)))) for _ in range(500)]
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(path)
    found = serving.QUERIES["slot_fill"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"create view lineitem as select * from '{path}/*.parquet'")
        want = con.execute(f"select identity, anchor, slot, key from ({serving.ORACLE_SQL['slot_fill']})").fetchall()
    assert sorted((tuple(x) for x in found), key=str) == sorted(want, key=str)


def test_texts_are_shuffled_without_their_terms(spark, monkeypatch):
    """Terms of texts are made behind the shuffle by group."""
    from shelfmark.llm import imatch

    seen = []
    edited = imatch.with_edited
    monkeypatch.setattr(imatch, "with_edited", lambda df: seen.append(df) or edited(df))
    rows = spark.createDataFrame([(i, f"some words {i % 7} of text {i}") for i in range(30)], "doc_id long, text string")
    assert imatch.fingerprint_pairs(rows).count() == 30
    assert "RepartitionByExpression [group" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
