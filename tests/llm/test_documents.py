"""Toxicity, Jaccard join, secrets and fingerprints on small documents."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import imatch, jaccard_join, secrets, toxicity

from .conftest import prose


@pytest.fixture(scope="module")
def toxic(spark, make_docs):
    r = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = prose(1000 + i, r.randint(20, 120))
        if bad:
            words = text.split()
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["scumbag", "filthling", "wretchish"]) + r.choice([".", ""]))
            text = " ".join(words)
        texts.append((i, text))
        labels.append((i, int(bad), int(bad)))
    return make_docs(texts), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), (999, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int"), dict(texts)


def test_held_out_toxicity(toxic):
    docs, labels, _ = toxic
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    rows = toxicity.score_documents(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    wrong = sum((r.score >= toxicity.THRESHOLD) != (r.doc_id % 5 == 0) for r in rows if r.held_out)
    assert wrong <= 2


def test_offending_sentences_are_located(make_docs, toxic):
    docs, labels, _ = toxic
    model = toxicity.train(docs, labels, F.lit(True))
    text = "The river was green. You scumbag and wretchish filthling! The garden in winter."
    row = toxicity.score_documents(make_docs([(1, text)]), model, spans=True).first()
    assert "scumbag" in text[row.worst_start : row.worst_end] and "garden" not in text[row.worst_start : row.worst_end]
    assert len(row.spans) == 1 and row.n_sentences == 3


def test_toxicity_of_odd_texts(spark, make_docs, odd_texts, toxic):
    docs, labels, _ = toxic
    model = toxicity.train(docs, labels, F.lit(True))
    rows = toxicity.score_documents(make_docs(odd_texts), model).collect()
    assert len(rows) == len(odd_texts) and all(r.score < toxicity.THRESHOLD for r in rows)
    none = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert none.chosen == [] and toxicity.score_documents(docs, none).where("score >= 0.7").count() == 0
    assert toxicity.score_documents(make_docs([]), model).count() == 0
    assert toxicity.with_scores(make_docs(odd_texts), model).columns[-1] == "score"


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(make_docs, odd_texts, width, percent):
    r = random.Random(9)
    texts = list(odd_texts)
    for g in range(12):
        base = prose(50 + g, r.choice([4, 12, 60, 200])).split()
        for k in range(r.choice([2, 6, 15])):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                words[r.randrange(len(words))] = r.choice(["edited", "other", "stone"])
            texts.append((1000 + 100 * g + k, " ".join(words) if k % 2 else "\n ".join(words).upper()))
    got = {tuple(x) for x in jaccard_join.jaccard_components(make_docs(texts), width, percent).collect()}
    assert got == brute_components(texts, width, percent)


def test_jaccard_of_empty_tables_and_repeated_rows(make_docs):
    assert jaccard_join.jaccard_components(make_docs([])).count() == 0
    rows = jaccard_join.jaccard_components(make_docs([(5, "a b c"), (5, "a b c"), (3, "A  b\tC"), (None, "a b c"), (4, None), (6, "")])).collect()
    assert sorted(map(tuple, rows)) == [(3, 1, 3), (4, 0, 4), (5, 1, 3), (5, 1, 3), (6, 0, 6)]


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 105)], "a long, b long")
    label = dict(map(tuple, jaccard_join.components(links).collect()))
    assert label == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100}


def test_hamming_distance_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(0)
    texts = [prose(i, 80) for i in range(20)]
    of, shingles = jaccard_join.shingle_sets(texts, 3)
    sets = [set(shingles[of == i].tolist()) for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(20), "text": texts})
    sketch = [np.array(x, np.int64) for x in next(jaccard_join._sketch(iter([batch]), 3)).column("sketch").to_pylist()]
    for _ in range(50):
        a, b = rng.integers(0, 20, 2)
        distance = sum((int(x) ^ int(y)).bit_count() for x, y in zip(sketch[a].view(np.uint64), sketch[b].view(np.uint64), strict=True))
        assert distance <= len(sets[a] ^ sets[b])


SECRET = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_secrets(spark, make_docs, odd_texts):
    r = random.Random(3)
    texts, planted = list(odd_texts), {}
    for i in range(200, 300):
        value = "".join(r.choice("0123456789abcdef") for _ in range(40))
        head = prose(i, 20)
        if i % 2:
            texts.append((i, f'{head} token = "{value}" {prose(i + 1, 10)}'))
            planted[i] = (len(head) + 10, value)
        else:
            texts.append((i, f"{head} {r.randrange(10**15, 10**16)} {prose(i + 1, 10)}"))
    found = secrets.scan(make_docs(texts)).collect()
    assert {r.doc_id: (r.start, r.value) for r in found if r.is_secret} == planted
    by_id = dict(texts)
    assert all(by_id[r.doc_id][r.start : r.start + r.length] == r.value for r in found)
    clean = {r.doc_id: r.text for r in secrets.redacted(make_docs(texts)).collect()}
    assert len(clean) == len(dict(texts)) and all((planted[i][1] not in t and secrets.MARK in t) if i in planted else t == by_id[i] for i, t in clean.items())


def test_secrets_of_empty_tables_and_without_labels(make_docs):
    assert secrets.scan(make_docs([])).count() == 0
    twice = f'x token = "{SECRET}"'
    rows = secrets.scan(make_docs([(1, twice), (1, twice), (2, None)])).collect()
    assert [(r.doc_id, r.start, r.is_secret) for r in rows] == [(1, 11, True)] * 2


def test_fingerprints(make_docs, odd_texts):
    texts = [(i, t) for i, t in odd_texts if t is None or len(t) < 100_000] + [(200 + i, prose(i, 150 + i)) for i in range(60)]
    rows = {r.doc_id: r for r in imatch.fingerprint_pairs(make_docs(texts)).collect()}
    order = sorted((i, t or "") for i, t in texts)
    same = defaultdict(set)
    for k, (i, t) in enumerate(order):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same[t].add(rows[i].fingerprint)
        assert (edited == t) <= (rows[i].near_edited == 1)
    assert all(len(x) == 1 for x in same.values())
    prose_rows = [rows[200 + i] for i in range(60)]
    assert sum(r.near_edited > r.near_next for r in prose_rows) >= 55


def test_fingerprints_of_small_tables(make_docs):
    assert imatch.fingerprint_pairs(make_docs([])).count() == 0
    one = imatch.fingerprint_pairs(make_docs([(7, "some words here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert imatch.fingerprint_pairs(make_docs([(7, None), (None, "x"), (8, ""), (8, "")])).count() == 3


def test_fingerprints_take_every_term_in_the_band(spark, make_docs):
    words = [f"w{i}x" for i in range(5000)]
    texts = [" ".join(words), " ".join(words)] + [" ".join(w for i, w in enumerate(words) if i % 100 != k) for k in range(8)]
    docs = list(enumerate(texts))
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprint_pairs(make_docs(docs + [(100 + i, f"filler{i}") for i in range(200)])).collect()}
    assert prints[0] == prints[1] and len({prints[i] for i, _ in docs}) == 9
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", imatch.term_hashes(F.col("text")))
    both = imatch.with_fingerprint(imatch.with_fingerprint(rows.crossJoin(rows.where("doc_id = 2").select(F.col("h").alias("i"))), "h", "h", "f"), "i", "i", "g")
    assert {r.doc_id: r.x == 1 for r in both.select("doc_id", imatch.likeness("f", "g").alias("x")).collect()} == {i: i == 2 for i, _ in docs}


def test_fingerprints_count_terms_and_not_buckets(spark, make_docs, odd_texts):
    texts = [(i, t) for i, t in odd_texts if t is None or len(t) < 100_000] + [(200 + i, prose(i, 150 + i) + f" seen{i // 3} once{i}") for i in range(60)]
    order = sorted((i, t or "") for i, t in texts)
    edited = [t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][1][: len(t) // 4] for k, (_, t) in enumerate(order)]
    hashed = spark.createDataFrame([(k, t) for k, t in enumerate([x for _, x in order] + edited)], "k int, text string").select("k", imatch.term_hashes(F.col("text")).alias("h"))
    terms = {r.k: r.h for r in hashed.collect()}
    n = Counter(h for k in range(len(order)) for h in terms[k])
    inside = {h for h, c in n.items() if 2 <= c <= max(2, int(0.05 * len(order)))}
    sets = spark.createDataFrame([(k, h, [x for x in h if x in inside]) for k, h in terms.items()], "k int, h array<long>, band array<long>")
    want = {r.k: r.x for r in imatch.with_fingerprint(sets, "h", "band", "f").select("k", imatch.as_text("f").alias("x")).collect()}
    got = sorted((r.doc_id, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in imatch.fingerprint_pairs(make_docs(texts)).collect())
    assert got == sorted((i, hashlib.sha256(edited[k].encode()).hexdigest(), want[k], want[len(order) + k]) for k, (i, _) in enumerate(order))


def test_terms_of_one_bucket_are_told_apart(spark, make_docs):
    h = {r.w: r.h >> 4 & (1 << 20) - 1 for r in spark.range(6000).select(F.concat(F.lit("q"), "id").alias("w")).withColumn("h", F.xxhash64("w")).collect()}
    of = defaultdict(list)
    for w, b in h.items():
        of[b].append(w)
    everywhere, telling = next(x for x in of.values() if len(x) > 1)[:2]
    base = "base alpha beta gamma delta epsilon"
    texts = [(1, f"{base} {telling}"), (2, f"{base} {telling}"), (3, base)] + [(10 + i, f"other{i}") for i in range(57)]
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprint_pairs(make_docs([(i, f"{t} {everywhere}") for i, t in texts])).collect()}
    assert prints[1] == prints[2] != prints[3]


def test_jaccard_of_one_doc_id_with_several_texts(make_docs):
    several = [prose(i, 200) for i in range(40, 46)]
    docs = make_docs([(1, t) for t in several] + [(10 + i, t.replace(t.split()[50], "changed", 1)) for i, t in enumerate(several)])
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == 12 and {(r.doc_id, r.component_id) for r in rows} == {(1, 1)} | {(10 + i, 1) for i in range(6)}
