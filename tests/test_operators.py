"""Matching, selection, sets, plans and serving on hand-made rows."""

import random

from pyspark.sql import functions as F

from shelfmark.functions import places
from shelfmark.operators import changes, fuzzy, match, select, serve, sets, slots, totals

CATALOG = "dat string, dat_priority int, ord long, name string, set_name string, size long, crc string, sha1 string"


def test_fallback_is_by_catalogue(spark):
    rows = [("A", 0, 1, "a1", None, 5, "c1", "s1"), ("A", 0, 2, "a2", None, 5, "c1", None), ("B", 1, 1, "b1", None, 5, "c1", None), ("B", 1, 2, "b2", None, 5, "c9", "s9"), ("C", 2, 1, "c1", None, 5, "c1", "s2")]
    catalog = spark.createDataFrame(rows, CATALOG)
    entries = spark.createDataFrame([(1, 5, "c1", "s1"), (2, 5, None, None)], "entry long, size long, crc string, sha1 string")
    found = {(r.entry, r.dat, r.name, r.via) for r in match.loose(entries, catalog).collect()}
    assert found == {(1, "A", "a1", "sha1"), (1, "B", "b1", "crc")}
    missing = {(r.dat, r.unit) for r in match.missing(catalog, match.loose(entries, catalog)).collect()}
    assert missing == {("A", "a2"), ("B", "b2"), ("C", "c1")}
    counts = {r.dat: (r.total, r.have, r.missing) for r in match.per_dat(catalog, match.loose(entries, catalog)).collect()}
    assert counts == {"A": (2, 1, 1), "B": (2, 1, 1), "C": (1, 0, 1)}


def test_sorts_put_unknown_last_both_ways(spark):
    rows = spark.createDataFrame([(1, "b", 7.0, 10), (2, "a", None, None), (3, "c", 9.0, 5), (4, "d", 7.0, 50), (5, "e", None, None)], "k int, name string, rating double, votes int")
    names = lambda kind: [r.name for r in serve.page(rows, serve.order_of(kind, "rating", "votes", "name", "votes", "votes", "k")).collect()]
    assert names("rating_desc") == ["c", "d", "b", "a", "e"]
    assert names("rating_asc") == ["b", "d", "c", "a", "e"]
    assert serve.page(rows, [F.col("k")], 1, 2).count() == 2 and serve.page(rows, [F.col("k")], 0, 0).count() == 1
    assert serve.search(rows.withColumn("other", F.lit("x")), "B\nX", ["name"]).count() == 0


def test_ties_stay_at_the_cutoff(spark):
    rows = spark.createDataFrame([(i, 10 - i // 3) for i in range(12)], "k int, rating int")
    assert select.top_with_ties(rows, 4, [-F.col("rating")]).count() == 6
    assert select.top_with_ties(rows, 40, [-F.col("rating")]).count() == 12
    assert select.top_with_ties(rows.where("false"), 4, [-F.col("rating")]).count() == 0


def test_as_of_is_the_newest_not_newer(spark):
    r = random.Random(1)
    anchors = [(i, r.randint(0, 3), r.randint(0, 20)) for i in range(40)]
    donors = [(100 + i, r.randint(0, 3), r.randint(0, 20)) for i in range(40)]
    got = sets.as_of(spark.createDataFrame(anchors, "id int, g int, t int"), spark.createDataFrame(donors, "d int, g int, t int"), "g", "t", ["d"], "d").collect()
    for row in got:
        best = max(((t, d) for d, g, t in donors if g == row.g and t <= row.t), default=(None, None))
        assert row.d == best[1]
    assert len(got) == 40


PARTS = "identity string, slot int, total int, version array<int>, flags array<string>, key string"


def test_slots_and_borrowing(spark):
    parts = spark.createDataFrame(
        [("g", 1, 2, [1, 2], [], "g1-v2"), ("g", 2, 2, [1, 1], [], "g2-v1"), ("g", 2, 2, [1, 3], [], "g2-v3"), ("g", 1, 2, [1, 3], ["cr"], "g1-v3"), ("h", 1, 3, [1], [], "h1"), ("h", 3, 3, [1], [], "h3"), ("k", 1, 3, [1], [], "k1")],
        PARTS,
    )
    got = {(r.anchor, r.slot): r.key for r in slots.filled(parts).collect()}
    assert got["g1-v2", 2] == "g2-v1" and got["g1-v3", 2] is None and got["h1", 2] is None
    done = {r.anchor: (r.complete, r.present) for r in slots.resolved(slots.filled(parts)).collect()}
    assert done["g1-v2"] == (True, ["g1-v2", "g2-v1"]) and done["h1"][0] is False
    lent = spark.createDataFrame([("h", 2, 3, [9], [], "x2", 1), ("h", 2, 3, [5], [], "y2", 0), ("k", 2, 3, [5], [], "z2", 0)], PARTS + ", tier int")
    got = {(r.anchor, r.slot): (r.key, r.source) for r in slots.filled(parts, lent).collect()}
    assert got["h1", 2] == ("y2", "borrowed") and got["h1", 3] == ("h3", "own") and got["k1", 2] == (None, None)


def test_claims_numbers_and_replay(spark):
    moves = spark.createDataFrame([(1, "b/x", "a/X"), (2, "c/x", "a/x"), (3, "d/y", "d/y"), (4, "e/y", "D/Y")], "k int, src string, dst string")
    assert {r.k: r.status for r in changes.claims(moves, "k", "src", "dst").collect()} == {1: "move", 2: "conflict", 3: "ok", 4: "conflict"}
    assert {r.k: r.free_target for r in changes.numbered(moves, "dst", [F.col("src")]).collect()} == {1: "a/X", 2: "a/x (2)", 3: "d/y", 4: "D/Y (2)"}
    log = spark.createDataFrame([(1, "p", "move"), (2, "p", "failed"), (3, "q", "failed"), (4, "q", "create")], "i int, path string, op string")
    assert [(r.path, r.op) for r in changes.replay(log, "path", "i", "op").collect()] == [("q", "create")]
    folders = spark.createDataFrame([("_Excluded/a",), ("_excluded",), ("games/a",)], "p string").select(places.reserved_folder(F.col("p")).alias("r")).collect()
    assert [r.r for r in folders] == ["_excluded", None, None]


def test_totals_rescue_and_overrides(spark):
    asked, owned = spark.createDataFrame([(1,), (2,)], "g int"), spark.createDataFrame([(2,), (3,)], "g int")
    assert {r.g: r.state for r in totals.combined(asked, owned, ["g"]).collect()} == {1: "missing", 2: "have", 3: "outside"}
    rows = spark.createDataFrame([(1, "r", True), (2, "r", False), (3, "s", True)], "k int, rel string, ex boolean")
    assert [r.k for r in select.rescue(rows, ["rel"], "ex").collect()] == [3]


def test_fuzzy_titles(spark):
    left = spark.createDataFrame([("p", "garden of eternal winters"), ("p", "gardens of eternel winter"), ("p", "space racer 2"), ("p", "alpha"), ("q", "gardens of eternel winter")], "plat string, key string")
    right = spark.createDataFrame([("p", "garden of eternal winter", 1), ("p", "space racer 3", 2), ("p", "alphas", 3), ("p", "unrelated garden", 4)], "plat string, key string, dbid long")
    # a plural alone is no match, nor is another platform
    assert [(r.plat, r.key, r.found, r.found_id) for r in fuzzy.matches(left, right).collect()] == [("p", "gardens of eternel winter", "garden of eternal winter", 1)]


def test_fuzzy_titles_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "SHARE_OF_WORD", 3, raising=False)
    import difflib
    import random

    r = random.Random(9)
    words = ["silver", "dragon", "warrior", "saga", "chronicle", "amber", "castle", "quest", "deluxe", "of", "the", "ii", "2", "x"]
    right = sorted({" ".join(r.choice(words) for _ in range(r.randint(2, 6))) for _ in range(150)})

    def spoiled(t):
        i = r.randrange(len(t))
        return "".join([t[:i], r.choice("aeioz s"), t[i + r.randint(0, 1) :]]).strip()

    left = sorted({" ".join(spoiled(t).split()) for t in right for _ in range(2)})
    ids = {t: i // 2 for i, t in enumerate(right)}
    numbers = lambda t: [{"ii": 2, "2": 2, "x": 10}[w] for i, w in enumerate(t.split()) if w in ("ii", "2") or w == "x" and t.split()[0] != "x"]
    want = set()
    for a in left:
        scored = []
        x = set(a.split())
        for b in right:
            y = set(b.split())
            plural = {w.rstrip("s") for w in x} == {w.rstrip("s") for w in y}
            if len(a) >= 7 and any(len(w) >= 4 for w in x & y) and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and not (x < y or y < x) and not plural and numbers(a) == numbers(b):
                ratio = difflib.SequenceMatcher(None, b, a, autojunk=False).ratio()
                if ratio >= 0.92:
                    scored.append((-ratio, b))
        scored.sort()
        if scored and (len(scored) == 1 or scored[1][0] - scored[0][0] >= 0.04 or ids[scored[0][1]] == ids[scored[1][1]]):
            want.add((a, scored[0][1]))
    found = fuzzy.matches(spark.createDataFrame([("p", t) for t in left], "plat string, key string"), spark.createDataFrame([("p", t, i) for t, i in ids.items()], "plat string, key string, dbid long"))
    assert len(want) > 10 and {(x.key, x.found) for x in found.collect()} == want



def test_counts_by_content_equal_those_by_pairs(spark):
    rows = [("A", 0, i, f"a{i}", f"set{i % 3}" if i % 2 else None, 0, "c0", "s0") for i in range(40)] + [("B", 1, 50, "b", None, 0, "c0", None), ("B", 1, 51, "b2", "S", 7, "c7", None), ("C", 2, 52, "c", None, 0, "c0", "s9")]
    catalog = spark.createDataFrame(rows, CATALOG)
    entries = spark.createDataFrame([(i, 0, "c0", "s0") for i in range(30)] + [(30, 7, "c7", None), (31, 7, "c7", None), (32, None, None, None), (33, 9, "c9", "s8")], "entry long, size long, crc string, sha1 string")
    pairs, found = match.loose(entries, catalog), match.by_content(entries, catalog)
    assert found.where("dat = 'A'").count() == 23 and pairs.where("dat = 'A'").count() == 1200
    for count in (match.per_dat, match.game_status, match.missing):
        assert sorted(map(str, count(catalog, found).collect())) == sorted(map(str, count(catalog, pairs).collect()))
    assert {r.entry for r in match.repeated_entries(entries, catalog).collect()} == {*range(1, 30), 31}
    assert match.repeated_entries(entries.limit(0), catalog).count() == 0 and match.per_dat(catalog, match.by_content(entries.limit(0), catalog)).count() == 3


def test_fuzzy_titles_with_long_rare_words_against_all_pairs(spark):
    """Titles of common words and a long rare one, spoiled in both, where all but few signs differ by chance."""
    import difflib
    import random

    r = random.Random(4)
    heads = ["large ring", "small ring", "large bolt", "cold plate"]
    right = sorted({" ".join(filter(None, [r.choice(heads), "".join(r.choice("abcdefgh") for _ in range(r.randint(20, 34))), r.choice(["", "deluxe"])])) for _ in range(60)})

    def spoiled(t):
        for _ in range(r.randint(1, 8)):
            i = r.randrange(len(t) + 1) if r.random() < 0.5 else r.randrange(10, len(t) - 8)
            t = "".join([t[:i], r.choice(["", "", "a", "q", "s", " "]), t[i + r.randint(0, 1) :]])
        return " ".join(t.split())

    left = sorted({spoiled(t) for t in right for _ in range(6)})
    bare = lambda t: {w.rstrip("s") for w in t.split()}
    want = {}
    for a in left:
        x = set(a.split())
        scored = []
        for b in right:
            y = set(b.split())
            if any(len(w) >= 4 for w in x & y) and not (x < y or y < x) and bare(a) != bare(b):
                ratio = difflib.SequenceMatcher(None, b, a, autojunk=False).ratio()
                if ratio >= 0.92:
                    scored.append((-ratio, b))
        scored.sort()
        if scored and (len(scored) == 1 or scored[1][0] - scored[0][0] >= 0.04):
            want[a] = scored[0][1]
    found = fuzzy.matches(spark.createDataFrame([("p", t) for t in left], "plat string, key string"), spark.createDataFrame([("p", t, i) for i, t in enumerate(right)], "plat string, key string, dbid long"))
    assert len(want) > 100 and {x.key: x.found for x in found.collect()} == want


def test_fuzzy_titles_of_common_words_are_not_compared_with_each_other(spark, monkeypatch):
    """Titles that share words but differ in a long one make few pairs: it isn't all titles of a word that are compared."""
    rows = spark.range(2000).selectExpr("'p' as plat", "concat('large ring standard ', translate(md5(cast(id as string)), '0123456789', 'ghijklmnop')) as key", "id as dbid")
    seen = []
    pieces = fuzzy._by_pieces
    monkeypatch.setattr(fuzzy, "_by_pieces", lambda *a: seen.append(pieces(*a)) or seen[-1])
    asked = rows.selectExpr("plat", "concat(left(key, char_length(key) - 1), 'z') as key")
    assert fuzzy.matches(asked, rows).count() == 2000
    assert sum(x.count() for x in seen) < 10000


def _rows_shuffled(spark):
    none = spark._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)))


def test_fuzzy_titles_are_looked_up_by_few_rows(spark):
    """Titles of common words that differ in a long one: a title makes few rows, whatever words it shares with others."""
    rows = spark.range(2000).selectExpr("'p' as plat", "concat(case when id % 2 = 0 then 'large ring standard ' else 'small gizmo promo ' end, translate(md5(cast(id as string)), '0123456789', 'ghijklmnop')) as key", "id as dbid")
    asked = rows.selectExpr("plat", "concat(left(key, char_length(key) - 1), 'z') as key")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _rows_shuffled(spark)
        assert fuzzy.matches(asked, rows).count() == 2000
        assert _rows_shuffled(spark) - before < 2000 * 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_unmatched_signs_against_all_beginnings():
    r = random.Random(5)

    def common(a, b):
        same = lambda x, y: x == y or fuzzy.ANY in (x, y) and " " not in (x, y)
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(max(last[j] + 1 if same(x, y) else 0, last[j + 1], row[j]))
        return row[-1]

    for _ in range(300):
        part, form = ("".join(r.choice(["a", "b", "c", " ", fuzzy.ANY]) for _ in range(r.randint(0, 9))) for _ in range(2))
        assert fuzzy.unmatched(part, form) == min(len(part) + i - 2 * common(part, form[:i]) for i in range(len(form) + 1))


def test_fuzzy_titles_spoiled_around_a_long_word_against_all_pairs(spark):
    """Spaces go and come beside the long word, words around it differ by few signs, a second long word is shared."""
    import difflib

    r = random.Random(12)
    heads, tails = ["cold plate", "old plate", "bold plates", "small ring a", "mall ring b", ""], ["", "deluxe", "de luxe", "x redux"]
    word = lambda n, signs: "".join(r.choice(signs) for _ in range(n))
    second = word(20, "abcdefghijkl")
    stems = [word(r.randint(26, 44), "abcdefghijkl") for _ in range(14)]

    def spoiled(t, most):
        for _ in range(r.randint(0, most)):
            spaces = [i for i, sign in enumerate(t) if sign == " "]
            i = max(0, min(len(t) - 1, (r.choice(spaces) + r.randint(-2, 2)) if spaces and r.random() < 0.5 else r.randrange(len(t))))
            t = "".join([t[:i], r.choice(["", "", "a", "q", " "]), t[i + r.randint(0, 1) :]])
        return " ".join(t.split())

    def title():
        return " ".join(filter(None, [r.choice(heads), second if r.random() < 0.1 else "", r.choice(stems), r.choice(tails)]))

    right = sorted({spoiled(title(), 3) for _ in range(150)})
    left = sorted({spoiled(t, 8) for t in right for _ in range(4)})
    bare = lambda t: {w.rstrip("s") for w in t.split()}
    long = lambda t: {w for w in t.split() if len(w) >= 4}
    want, pairs = {}, 0
    for a in left:
        scored = []
        for b in right:
            x, y = set(a.split()), set(b.split())
            ten = lambda t: [w for i, w in enumerate(t.split()) if w in ("ii", "iii", "iv", "vi", "vii", "viii", "ix") or i and w in ("x", "v")]
            if long(a) & long(b) and not (x < y or y < x) and bare(a) != bare(b) and ten(a) == ten(b):
                ratio = difflib.SequenceMatcher(None, b, a, autojunk=False).ratio()
                if ratio >= 0.92:
                    scored.append((-ratio, b))
        scored.sort()
        pairs += len(scored)
        if scored and (len(scored) == 1 or scored[1][0] - scored[0][0] >= 0.04):
            want[a] = scored[0][1]
    lefts, rights = spark.createDataFrame([("p", t) for t in left], "plat string, key string"), spark.createDataFrame([("p", t, i) for i, t in enumerate(right)], "plat string, key string, dbid long")
    found = {x.key: x.found for x in fuzzy.matches(lefts, rights).collect()}
    assert len(want) > 30 and pairs > 500 and found == want
