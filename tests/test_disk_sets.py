"""Sets of disks filled as of a version, and disks borrowed from other editions.

A selection decides each catalogue by itself, so all cases of a profile are catalogues of one selection."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import disks, tags
from shelfmark.operators import disk_sets, library

EN = library.Profile(languages=["En"])
A = "Mole (1991)(Den)(Disk {} of 3)".format
OTHER = "Mole (1991)(Den)(DE)(Disk 2 of 3)"
OLD, NEW = "Mole (1990)(Den)(ES)(Disk 2 of 3)", "Mole (1992)(Den)(IT)(Disk 2 of 3)"
K, S, I, X = "keep", "superseded", "incomplete", "excluded"

#: Names, the action of each with and without borrowing, and the kept sets with it: name and names of disks.
CASES = {
    "as of a version": (["Zap v1.0 (1990)(Den)(Disk 1 of 2)", "Zap v1.0 (1990)(Den)(Disk 2 of 2)", "Zap v1.1 (1990)(Den)(Disk 1 of 2)"], [S, K, K], [S, K, K], {"Zap v1.1 (1990)(Den)": [2, 1]}),
    # a newer second disk isn't filled in behind an older first one, but it may be lent
    "newer than its set": (["Zap v1.0 (1990)(Den)(Disk 1 of 2)", "Zap v1.1 (1990)(Den)(Disk 2 of 2)"], [K, K], [I, I], {"Zap v1.0 (1990)(Den)": [0, 1]}),
    "cracked first": (["Zap (1990)(Den)(Disk 1 of 2)[cr SR]", "Zap (1990)(Den)(Disk 2 of 2)", "Zap (1990)(Den)(Disk 1 of 2)"], [K, K, S], [K, K, S], {"Zap (1990)(Den)[cr SR]": [0, 1]}),
    # a crack that disk 2 alone carries makes a set with the bare disk 1, whose name comes first
    "a crack more": (["Zap (1990)(Den)(Disk 1 of 2)[cr SR]", "Zap (1990)(Den)(Disk 2 of 2)[cr]", "Zap (1990)(Den)(Disk 2 of 2)", "Zap (1990)(Den)(Disk 1 of 2)"], [S, K, S, K], [S, K, S, K], {"Zap (1990)(Den)[cr]": [3, 1]}),
    "flags of a later disk": (["Zap (1990)(Den)(Disk 1 of 2)", "Zap (1990)(Den)(Disk 2 of 2)[t +3]"], [K, K], [K, K], {"Zap (1990)(Den)[t +3]": [0, 1]}),
    "two cracks": (["Zap (1990)(Den)(Disk 1 of 2)[cr A]", "Zap (1990)(Den)(Disk 2 of 2)[cr B]"], [I, I], [I, I], {}),
    "no first disk": ([A(2), A(3)], [I, I], [I, I], {}),
    "a crack of one disk": ([A(1), "Mole (1991)(Den)(Disk 2 of 3)[cr B]", A(3)], [K] * 3, [K] * 3, {"Mole (1991)(Den)[cr B]": [0, 1, 2]}),
    "a single": (["Mole (1991)(Den)", A(1)], [K, S], [K, S], {"Mole (1991)(Den)": [0]}),
    "another country": ([A(1), A(3), OTHER], [K, K, K], [I, I, X], {"Mole (1991)(Den)": [0, 2, 1]}),
    "own first": ([A(1), A(2), A(3), OTHER], [K, K, K, X], [K, K, K, X], {"Mole (1991)(Den)": [0, 1, 2]}),
    "whole already": ([A(1), A(2), A(3), "Mole v1.1 (1992)(Den)(Disk 1 of 3)[cr Q]", OTHER], [S, K, K, K, X], [S, K, K, K, X], {"Mole v1.1 (1992)(Den)[cr Q]": [3, 1, 2]}),
    "all or nothing": ([A(1), OTHER], [I, X], [I, X], {}),
    "newest of others": ([A(1), A(3), OLD, NEW], [K, K, X, K], [I, I, X, X], {"Mole (1991)(Den)": [0, 3, 1]}),
    "fits the crack": (["Zap (1990)(Den)(Disk 1 of 2)[cr X]", "Zap (1990)(Den)(DE)(Disk 2 of 2)[cr Y]", "Zap (1990)(Den)(FR)(Disk 2 of 2)"], [K, X, K], [I, X, X], {"Zap (1990)(Den)[cr X]": [0, 2]}),
    "runs on both": (["Zap (1990)(Den)(AGA)(Disk 1 of 2)", "Zap (1990)(Den)(DE)(OCS-AGA)(Disk 2 of 2)"], [K, K], [I, X], {"Zap (1990)(Den)(AGA)": [0, 1]}),
    "equal names": ([A(1), A(1), A(2), A(3)], [K, S, K, K], [K, S, K, K], {"Mole (1991)(Den)": [0, 2, 3]}),
}
NEVER = ["(DE)(Disk 2 of 3)[b]", "(DE)(Disk 2 of 3)[v Worm]", "(DE)(beta)(Disk 2 of 3)", "(DE)(Disk 2 of 4)", "(DE)(AGA)(Disk 2 of 3)", "(DE)(Disk 2 of 3)[cr Y]"]
for tail in NEVER:
    CASES[f"never {tail}"] = ([A(1), A(3), f"Mole (1991)(Den){tail}"], [I, I, None], [I, I, None], {})
for whole in ("Mole (1991)(Hill)(DE)(Disk 2 of 3)", "Mole II (1991)(Den)(DE)(Disk 2 of 3)"):
    CASES[f"never {whole}"] = ([A(1), A(3), whole], [I, I, None], [I, I, None], {})


@pytest.fixture(scope="module")
def items(spark):
    rows = [(100 * c + i, dat, n, "") for c, (dat, (names, *_)) in enumerate(CASES.items()) for i, n in enumerate(names)]
    return library.prepared(tags.parse_dated(spark.createDataFrame(rows, "key long, dat string, name string, form string"), "name", "t"))


@pytest.mark.parametrize("borrow", [True, False])
def test_decisions(items, borrow):
    rows = library.select(items, library.Profile(languages=["En"], borrow_editions=borrow), styles=(tags.DATED,)).orderBy("key").collect()
    got = {dat: [r.action for r in rows if r.dat == dat] for dat in CASES}
    for dat, (names, with_, without, _) in CASES.items():
        want = with_ if borrow else without
        got[dat] = [None if w is None else g for g, w in zip(got[dat], want, strict=True)]
    assert got == {dat: case[1 if borrow else 2] for dat, case in CASES.items()}
    by = {(r.dat, r.name): r for r in rows}
    assert by["as of a version", "Zap v1.0 (1990)(Den)(Disk 1 of 2)"].superseded_by == "Zap v1.1 (1990)(Den)"
    assert by["no first disk", A(2)].missing == [1] and by["all or nothing", A(1)].missing == [2, 3]
    lent = by["another country", OTHER]
    if borrow:
        assert lent.codes == ["borrowed"] and lent.detail == "borrowed as disk 2 of Mole (1991)(Den) from the (DE) edition"
        assert by["another country", A(1)].codes == []
    else:
        assert lent.codes == ["language"]


def test_sets(items):
    sets = library.dated_sets(items, EN)
    rows = sets.where("kept").collect()
    own = [r for r in rows if len(r.disks) > 1 or r.dat == "a single"]
    got = {dat: {r.set_name: [d.name for d in r.disks] for r in own if r.dat == dat} for dat in CASES}
    assert got == {dat: {n: [names[i] for i in places] for n, places in want.items()} for dat, (names, _, _, want) in CASES.items()}
    note = next(r for r in rows if r.dat == "another country").lent[0]
    assert (note.slot, note.edition, note.differences) == (2, "(DE)", ["country", "language"])
    assert "year" in next(r for r in rows if r.dat == "newest of others").lent[0].differences
    summary = disk_sets.borrow_summary(sets.where("dat = 'another country'")).first()
    assert (summary["sets"], summary["disks"], [tuple(x) for x in summary["differences"]]) == (1, 1, [("country", 1), ("language", 1)])


def test_a_selected_language_is_borrowed_first(spark):
    names = [A(1), A(3), NEW, "Mole (1991)(Den)(FR)(Disk 2 of 3)"]
    rows = spark.createDataFrame([(i, "D", n, "") for i, n in enumerate(names)], "key int, dat string, name string, form string")
    found = library.dated_sets(library.prepared(tags.parse_dated(rows, "name", "t")), library.Profile(languages=["En", "Fr"]))
    assert [r.lent[0].name for r in found.where("lent is not null").collect()] == [names[3]]


def test_fitting_flags(spark):
    cases = [("cr", "cr SR", True), ("cr2", "cr SR", True), ("a", "a2", False), ("h PDX", "h PDX - RSi", True), ("cr A", "cr B", False), ("!", "", True), ("beta 2", "", False), ("AGA version", "", False), ("t", "t", True), ("docs", "cr X", True)]
    rows = spark.createDataFrame([([a], [b] if b else []) for a, b, _ in cases], "f array<string>, w array<string>")
    assert [r.x is not None for r in rows.select(disks.fit(F.col("f"), F.col("w")).alias("x")).collect()] == [x for *_, x in cases]


def test_sets_of_no_names(items):
    assert library.select(items.where("false"), EN, styles=(tags.DATED,)).count() == 0
