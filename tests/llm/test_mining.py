"""Hard negatives, mixes of sources and collocations against plain versions, on odd tables."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import collocations, hard_negatives, mixing

VECTORS = "vec_id long, embedding array<float>, label int, score double, dim int, salt int, part int, rank int"


def negatives_by_hand(rows, positives=5, k=3):
    good = [(i, [floor(256 * x) for x in e], label) for i, e, label, *_ in rows if i is not None and e and label is not None and all(x is not None and abs(x) < float("inf") for x in e)]
    out = []
    for a in sorted({i for i, *_ in good if i % 50 == 0}):
        _, x, label = min(((i, e, l) for i, e, l in good if i == a), key=lambda r: (r[2], len(r[1]), r[1]))
        others = sorted((-sum(p * q for p, q in zip(x, e)), i, l) for i, e, l in good if i != a and len(e) == len(x))
        for ps, p, _ in [o for o in others if o[2] == label][:positives]:
            found = [(s, i) for s, i, l in others if l != label and 50 * -ps <= 100 * -s <= 95 * -ps][:k]
            out += [(a, p, nth, i, -ps, -s) for nth, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.1, 0.25, 0.5, 0.7]) for _ in range(3)], r.randrange(3)) for i in range(-100, 500)]
    rows += [(1000 + i, [0.5, 0.5, 0.5], 1) for i in range(300)] + [(2000 + i, [0.45, 0.5, 0.45], 2) for i in range(300)]
    rows += [(50, [0.7, 0.7], 1), (3000, [0.7, 0.7], 1), (3001, [0.6, 0.6], 2), (3002, [], 1), (3003, None, 1), (None, [0.5] * 3, 1), (3004, [0.5] * 3, None)]
    rows += [(3005, [0.5, None, 0.5], 2), (3050, [float("inf")] * 3, 2), (3006, [float("nan")] * 3, 2), (100, [0.5, 0.5, 0.5], 0), (101, [0.7] * 3, 1), (101, [0.7] * 3, 1)]
    r.shuffle(rows)
    vectors = spark.createDataFrame([(*x, 0.5, 7, 3, 1, 2) for x in rows], VECTORS).repartition(5)
    step = F.col("vec_id") % 50 == 0
    got = hard_negatives.hard_negatives(vectors, step).drop("positive_rank").collect()
    want = negatives_by_hand(spark_floats(rows))
    assert want and sorted(map(tuple, got)) == want
    assert hard_negatives.hard_negatives(vectors.where("false"), step).count() == 0


def spark_floats(rows):
    import numpy as np

    return [(i, e and [None if x is None else float(np.float32(x)) for x in e], label) for i, e, label in rows]


def test_hard_negatives_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 3)
    r = random.Random(6)
    rows = [(i, [r.random() for _ in range(4)], r.randrange(4)) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0).drop("positive_rank").collect()
    assert sorted(map(tuple, got)) == negatives_by_hand(spark_floats(rows))


def test_limits_of_large_scores():
    import numpy as np

    scores = [0, 1, 7, 99, 100, 101, -1, -99, -100, -101, (1 << 61) - 1, -(1 << 61)]
    for part in (50, 95):
        low, high = hard_negatives._hundredths(np.array(scores), part)
        assert low.tolist() == [floor(Fraction(part * s, 100)) for s in scores]
        assert high.tolist() == [-floor(Fraction(-part * s, 100)) for s in scores]


DOCS = "doc_id long, text string, source string, size long, target double, key string, begin string, weight double, rest long, whole long, id long, _part int"


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = Fraction(share) * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total > epochs * sizes[s]}
        if not over:
            out |= {s: weight[s] * left / total for s in open_}
            break
        out |= {s: Fraction(epochs * sizes[s]) for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        open_ -= over
    return out


def mix_texts():
    r = random.Random(7)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "b", "c", "é", "Z", "zz", None])) for i in range(800)]
    rows += [(900, "same words here", "b")] * 400 + [(None, "no id", "b"), (None, None, "b"), (901, None, "empty"), (902, "", "empty"), (903, " \n\t\x0b", "empty")]
    rows += [(904, "x " * 40_000, "a"), (905, "a b c d", "c"), (906, "one", "tiny")]
    return rows


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SORTED_ROWS", 20)
    rows = mix_texts()
    docs = spark.createDataFrame([(*x, 1, 2.0, "k", "b", 3.0, 4, 5, 6, 7) for x in rows], DOCS).repartition(4)
    got = mixing.mixed(docs, keep=["text"]).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets_by_hand(dict(sizes))
    assert len(got) == len(rows)
    taken, partly = Counter(), Counter()
    for row in got:
        assert row["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))
        assert row["source_size"] == sizes[row["source"]] and row["target"] == pytest.approx(float(want[row["source"]]))
        assert 0 <= row["taken"] <= 2 * row["size"]
        taken[row["source"]] += row["taken"]
        partly[row["source"]] += bool(row["size"] and row["taken"] % row["size"])
    assert all(taken[s] == floor(want[s] + Fraction(1, 2)) for s in sizes) and max(partly.values()) == 1
    again = mixing.mixed(docs.repartition(7), keep=["text"]).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(got, key=str) == sorted(mixing.mixed(docs, keep=["text"]).collect(), key=str)


def test_repetitions_of_a_mix(spark):
    docs = spark.createDataFrame(mix_texts(), "doc_id long, text string, source string")
    mix = mixing.mixed(docs, keep=["text"])
    words = mixing.repetitions(mix).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n"))
    want = mix.groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0")
    assert sorted(words.collect(), key=str) == sorted(want.collect(), key=str)


def test_mixes_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mixed(docs).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mixed(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="whole"):
        mixing.mixed(docs, epochs=1.5)


@pytest.mark.parametrize("share", [0.3, 1.5, 2.0, 2.5])
def test_water_filling(spark, share):
    r = random.Random(int(share * 10))
    sizes = {f"s{i}": r.choice([0, 1, 10, 500, 10_000, 99_999]) for i in range(25)}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    rows = mixing.cycled(sources, (5, 2, 1)).withColumn("cap", F.col("source_size") * 2)
    got = {x.source: x.target for x in mixing.water_filled(rows, share * sum(sizes.values())).collect()}
    assert got == {s: pytest.approx(float(t)) for s, t in targets_by_hand(sizes, share=share).items()}


def phrases_by_hand(rows, least, best=2000, most=5):
    words, grams = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in range(1, most + 1):
                grams.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    common = {g: n for g, n in grams.items() if n >= least}
    out = {}
    for (lang, g), a in common.items():
        if len(g) < 2 or any(l == lang and len(h) > len(g) and n >= a and any(h[i : i + len(g)] == g for i in range(len(h))) for (l, h), n in common.items()):
            continue
        cuts = [(1000 * a * words[lang] // (common[lang, g[:k]] * common[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), common[lang, g[:k]], common[lang, g[k:]], words[lang]))
    return sorted((lang, i, g.decode(), -a, l, r, n, -score) for lang, found in out.items() for i, (score, a, g, l, r, n) in enumerate(sorted(found)[:best], 1))


def phrase_texts():
    r = random.Random(8)
    some = ["new", "York", "city", "of", "the", "big", "apple", " é", "日本", "\x00", "x y"]
    texts = [" ".join(r.choice(["New york city", "the big", r.choice(some), r.choice(some) + r.choice(".,;:!?\n\r\x0b\x0c\t ")]) for _ in range(r.randint(0, 80))) for _ in range(120)]
    rows = [(i, t, r.choice(["en", "en", "de", None, "und", ""])) for i, t in enumerate(texts)]
    return rows + [(1, None, "en"), (None, "", None), (2, "of of of of of of of of", "en"), (3, "new york city! " * 30, "fr"), (3, "new york city! " * 30, "fr"), (4, "rare", "xx")]


PHRASES = "doc_id long, text string, lang string, n long, word string, id long, phrase string, a long, rank int"


def test_collocations(spark):
    rows = phrase_texts()
    docs = spark.createDataFrame([(*x, 1, "w", 2, "p", 3, 4) for x in rows], PHRASES).repartition(3)
    want = phrases_by_hand(rows, 8)
    assert len(want) > 50
    for chunks in ({}, {"chunk_words": 3, "chunk_pairs": 5}):
        got = collocations.collocations(docs, least=8, **chunks).collect()
        assert sorted(map(tuple, got)) == want
    assert sorted(map(tuple, collocations.collocations(docs, least=8, best=3, most_words=3).collect())) == phrases_by_hand(rows, 8, 3, 3)


def test_few_collocations(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs, least=1).count() == 1


def test_collocations_of_a_very_long_text(spark):
    """Parts of a long text meet without loss, and counts are handed on before they fill a task."""
    text = "Alpha beta\tgamma. " * 600_000
    docs = spark.createDataFrame([(1, text, "en"), (2, " ".join(f"w{i}" for i in range(700_000)), "en")], "doc_id long, text string, lang string")
    got = [tuple(r) for r in collocations.collocations(docs).collect()]
    # beta gamma and alpha beta always stand inside the longer one
    assert got == [("en", 1, "alpha beta gamma", 600_000, 600_000, 600_000, 2_500_000, 1000 * 2_500_000 // 600_000)]


def test_scores_beyond_64_bits(spark):
    level = spark.createDataFrame([(1, "en", "a b", 10**13, [10**13, 10**13], [10**13, 10**13], 10**15)], "id long, lang string, phrase string, a long, heads array<long>, tails array<long>, n long")
    assert collocations._scored(level, 2).first().score == 1000 * 10**13 * 10**15 // 10**26
