"""Names, versions and tags."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import names, tags


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, names.strip_ext(lit("a.b.rom"))) == "a.b"
    assert one(spark, names.hex_digest(lit(" 0xAB1 "), 8)) == "00000ab1"
    assert one(spark, names.hex_digest(lit("123456789"), 8)) == "123456789"
    assert one(spark, names.int_or_zero(lit("x"))) == 0 and one(spark, names.int_or_zero(lit(" 12 "))) == 12
    assert one(spark, names.date_key(lit("199X-??"))) == "1990-00"
    assert one(spark, names.title_key(lit("The Baker's Dozen & Co: Part II"))) == "bakers dozen and co part ii"
    assert one(spark, names.roman_key(lit("part ii of xv"))) == "part 2 of xv"
    assert one(spark, names.roman_key(lit("mega man x"))) == "mega man x"
    assert one(spark, names.number_signature(lit("part ii of 15"))) == ["2", "15"]
    assert one(spark, names.number_signature(lit("x men legends"))) == [] and one(spark, names.number_signature(lit("mega man x 007"))) == ["10", "7"]
    assert one(spark, names.title_key(lit("Pok\u00e9mon: Blue, The"))) == "pokemon blue"
    assert one(spark, names.title_key(lit("Tale of Kings, A - The \u2116 \uff11 / An Isle: It\u2019s"))) == "tale of kings no 1 isle its"
    assert one(spark, names.version_parts(lit("v20240101123456"))) == [20240101123456]
    assert tuple(one(spark, names.disk_position(lit("X (Disk B of 4)")))) == (2, 4)
    assert one(spark, names.safe_filename(lit('a:b*c?. '))) == "a_b_c_" and one(spark, names.safe_filename(lit("con.txt"))) == "_con.txt"
    assert one(spark, names.equal_if_known(lit(""), lit("ab"))) is None and one(spark, names.equal_if_known(lit("AB"), lit("ab"))) is True


REGION_FIRST = [
    ("Foo (USA, Europe) (En,Pt-BR) (Rev A) (Beta 2) (Alt)[b1][T+Fre].rom", dict(title="Foo", regions=["USA", "Europe"], languages=["En", "Pt"], version="Rev A", status="Beta 2", flags=["Pt-BR", "Alt"], dump_flags=["b1", "T+Fre"], bad=True, video=["NTSC", "PAL"])),
    ("[BIOS] Boot (World)", dict(title="Boot", regions=["World"], languages=["En"], dump_flags=["BIOS"], bios=True, bad=False)),
    ("Sansu (Jou) (Japan)", dict(title="Sansu (Jou)", regions=["Japan"], languages=["Ja"], languages_implied=True)),
    ("Smile (^^; Two (Europe)", dict(title="Smile (^^; Two", regions=["Europe"], video=["PAL"])),
    ("Plain", dict(title="Plain", regions=[], languages=[], version="", flags=[])),
    ("Two (USA) (Japan) (v1.0) (v2.0)", dict(regions=["USA"], version="v1.0", flags=["Japan", "v2.0"])),
]
DATED = [
    ("Zap v1.3c (demo) (1991-05-xx)(Soft)(GB-DE)(en-de)(Disk 1 of 2)[cr X]", dict(title="Zap", version="v1.3c", status="demo", date="1991-05-xx", publisher="Soft", regions=["United Kingdom", "Germany"], languages=["En", "De"], flags=["Soft", "Disk 1 of 2"], dump_flags=["cr X"])),
    ("Old (19xx)(-)[b]", dict(title="Old", date="19xx", publisher="-", flags=["-"], bad=True)),
    ("None", dict(title="None", version="", date="", publisher="", flags=[])),
    ("Mole v1.3 rev1 (1990)(Burrow)", dict(title="Mole", version="v1.3 rev1")),
    ("Mole v1.44GE (1990)(Burrow)(PAL)", dict(title="Mole", version="v1.44", flags=["GE", "Burrow", "PAL"], video=["PAL"])),
    ("Rev 2 (1990)(Burrow)", dict(title="Rev 2", version="")),
    ("Mole Rev 2 (199x-1?)(Burrow)", dict(title="Mole", version="Rev 2", date="199x-1?")),
]


@pytest.mark.parametrize(("parse", "cases"), [(tags.parse_region_first, REGION_FIRST), (tags.parse_dated, DATED)])
def test_grammars(spark, parse, cases):
    rows = parse(spark.createDataFrame([(i, n) for i, (n, _) in enumerate(cases)], "i int, name string"), "name", "t").orderBy("i").collect()
    for row, (name, want) in zip(rows, cases, strict=True):
        assert {k: row.t[k] for k in want} == want, name
    assert parse(spark.createDataFrame([(None,)], "name string"), "name", "t").count() == 1


def test_version_order(spark):
    texts = ["", "Rev 1", "Rev 2", "Rev 10", "v1.0-alpha", "v1.0-beta2", "v1.0-beta3", "v1.0-rc1", "v1.0", "v1.0a", "v1.2", "v1.10"]
    rows = spark.createDataFrame(enumerate(texts), "i int, v string").withColumn("k", tags.version_key(F.col("v")))
    got = {r.v: list(r.k) for r in rows.collect()}
    assert got[""] == [0] and got["Rev 2"] == [1, 2] and got["v1.10"] == [1, 1, 10] and got["v1.0a"] == [1, 1, 0, 1]
    v = [t for t in texts if t.startswith("v")]
    assert sorted(v, key=got.get) == v and sorted(texts[:4], key=got.get) == texts[:4]


def test_rules(spark):
    cases = {
        ("(", "Alt, Beta"): "pre_release", ("(", "demo-playable"): "demo", ("(", "Trial Disk"): None, ("(", "Kiosk 2"): "demo", ("[", "b"): "bad_dump", ("[", "b2 cut"): "bad_dump", ("[", "bf"): None, ("[", "a2 Bad Dump"): "bad_dump",
        ("[", "inc. virus"): "virus", ("[", "o3"): "bad_size", ("[", "modified copy"): "modified", ("[", "modifieds"): None, ("[", "Technical Demo"): "demo", ("[", "fake"): "faked", ("[", "Fake"): None, ("[", "proto"): "prototype", ("[", "m baddump"): "modified",
    }
    rows = spark.createDataFrame([(*k, w) for k, w in cases.items()], "kind string, text string, want string").withColumn("got", tags.token_rule(F.col("kind"), F.col("text"))).collect()
    assert [(r.kind, r.text, r.got) for r in rows if r.got != r.want] == []
    assert one(spark, tags.token_rule(F.lit("("), F.lit("Trial Disk"), tags.DISC)) == "demo"
    found = one(spark, tags.exclusion_rules(F.lit("Beta"), F.array(F.lit("Unreleased"), F.lit("Alt")), F.array(F.lit("b"), F.lit("m edited"), F.lit("bootable"))))
    assert found == ["pre_release", "unreleased", "bad_dump", "modified"]
