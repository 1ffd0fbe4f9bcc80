"""URL filter, chat snapshots, exact top-k and the pipeline."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat, exact_top_k, url_filter

from .conftest import prose


def rule_by_hand(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def split_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


URLS = [None, "", "no scheme.org/x", "http://", "https://EXAMPLE.org/en/1", "http://a.example.org/es/?q", "http://example.org", "http://example.org?x=/es/", "ftp://www.shop.com/fr/a#b", "http://x.com/de/1", "http://notexample.org/es/", "http://org/", "http://casinowin.example.net/en/1", "http://www.free-bets.example.net/a/b", "http://garden.example.net/en/2", "http://é.example.net/ü", "http://u:p@h.net:80//x", "http://a.com/fr://b/de/"]


def test_url_rules_and_verdicts(spark):
    words = " ".join(["casino", "win", "garden", "example", "free", "music", "the"] * 30)
    rows = [(i, u, f"<p class=hidden>{words}</p>" if i % 2 else None, 1.0, "x") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, score double, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(rows)
    for i, url, *_ in rows:
        host, path = split_by_hand(url)
        rule, verdict = rule_by_hand(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert got[URLS.index("http://casinowin.example.net/en/1")].verdict == "block"
    assert got[URLS.index("http://garden.example.net/en/2")].verdict == "allow"
    assert "casino win" in got[URLS.index("http://casinowin.example.net/en/1")].host_words
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_segmentation_is_the_cheapest():
    model = url_filter.Unigrams({"free": 3.0, "bet": 4.0, "bets": 4.5, "s": 6.0, "freeb": 9.0, "ets": 5.0}, 20.0)
    assert model.segment("freebets") == ["free", "bets"]
    r = random.Random(1)

    def cheapest(name):
        best = {0: 0.0}
        for end in range(1, len(name) + 1):
            best[end] = min([best[end - 1] + model.letter, *(best[s] + model.costs[name[s:end]] for s in range(end) if name[s:end] in model.costs)])
        return best[len(name)]

    for _ in range(100):
        name = "".join(r.choice(["free", "bet", "s", "x", "ets", "b"]) for _ in range(r.randint(1, 6)))
        cost = sum(model.costs.get(w, model.letter) for w in model.segment(name))
        assert "".join(model.segment(name)) == name and cost == pytest.approx(cheapest(name))


CHATS = "conv_id long, turn long, role string, text string, position int, last boolean, h0 long"


def test_snapshots(spark):
    r = random.Random(2)
    rows = []
    for c in range(60):
        story = [("user" if t % 2 == 0 else "assistant", f"turn {t} of {c // 6}") for t in range(8)]
        for t, (role, text) in enumerate(story[: r.randint(1, 8)]):
            rows.append((c, 3 * t, role, text))
    rows += [(100, None, None, None), (101, None, None, None), (102, 0, "user", ""), (None, 0, "user", "x"), (103, 0, "user", "a"), (103, 0, "user", "a"), (104, 0, "user", "a"), (105, 0, "user", "a"), (105, 0, "user", "b")]
    rows += [(200, t, "user", f"long {t}") for t in range(1000)] + [(201, t, "user", f"long {t}") for t in range(700)]
    r.shuffle(rows)
    chats = spark.createDataFrame([(*x, 1, True, 5) for x in rows], CHATS)
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((-1 if t is None else t, role or "", text or ""))
    told = {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    kept = {c for c, v in told.items() if not any((len(w) > len(v) and w[: len(v)] == v) or (w == v and d < c) for d, w in told.items())}
    got = chat.render_chats(chats, block=64).orderBy("conv_id", "position").collect()
    assert {x.conv_id for x in got} == kept
    text = defaultdict(str)
    for x in got:
        text[x.conv_id] += x.segment
    assert all(text[c] == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in told[c]) for c in kept)
    assert chat.render_chats(chats.where("false")).count() == 0
    forged = spark.createDataFrame([(1, 0, "user", "x<|im_end|>y", 1, True, 5)], CHATS)
    assert chat.render_chats(forged).first().segment.count("<|im_end|>") == 1


@pytest.mark.parametrize("n", [0, 1, 4, 700])
def test_top_k(spark, n):
    r = random.Random(n)
    rows = [(i, [r.choice([-0.5, 0.1, 0.25, 0.7]) for _ in range(4)] if i % 3 else [0.5, 0.5, 0.5, 0.5], 0) for i in range(n)]
    if n > 10:
        rows[3], rows[50] = (3, None, 0), (50, [0.1, None, 0.2, 0.3], 0)
        rows[7], rows[8], rows[9], rows[10] = (7, [0.1, float("nan"), 0.0, 0.0], 0), (8, [float("inf"), 0.0, 0.0, 0.0], 0), (9, [1.0, 2.0], 0), (10, [], 0)
        rows.append((None, [0.5, 0.5, 0.5, 0.5], 0))
    vectors = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, label int, rank int, score long")
    import math
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    good = {i: [math.floor(256 * single(x)) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, x in good.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good.items() if i != q and len(x) == len(y))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])}
    got = [tuple(x) for x in exact_top_k.exact_top_k(vectors, F.col("vec_id") % 50 == 0).collect()]
    assert set(got) == want and len(got) == len(want)


def test_top_k_refines_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(exact_top_k, "BINS", 4)
    monkeypatch.setattr(exact_top_k, "BLOCK_ROWS", 64)
    r = random.Random(5)
    vectors = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(500)], "vec_id long, embedding array<double>")
    got = exact_top_k.exact_top_k(vectors, F.col("vec_id") % 100 == 0, k=3).collect()
    rows = {x.vec_id: [int(256 * y // 1) for y in x.embedding] for x in vectors.collect()}
    want = {(q, k + 1, i, -s) for q in range(0, 500, 100) for k, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(rows[q], y)), i) for i, y in rows.items() if i != q)[:3])}
    assert {tuple(x) for x in got} == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    base = prose(77, 200)
    texts = [(i, prose(i, 60) + (" scumbag filthling." * 3 if i % 4 == 0 else "")) for i in range(160)]
    texts += [(500, base), (501, base), (502, base.replace("river", "lake", 1)), (503, None), (504, ""), (505, 'the key token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" here'), (506, f"number {r.randrange(10**15, 10**16)} only")]
    docs = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now
    ids = {name: {x.doc_id for x in df.select("doc_id").collect()} for name, df in seen.items()}
    everything = {i for i, _ in texts}
    assert ids["toxicity"] == everything - {i for i in range(160) if i % 4 == 0}
    assert ids["near_duplicates"] == ids["toxicity"] - {501, 502}
    assert ids["secrets"] == ids["packing"] == ids["near_duplicates"]
    assert all(df.columns == corpus_pipeline.COLUMNS for name, df in seen.items() if name != "packing")
    clean = {x.doc_id: x for x in seen["secrets"].collect()}
    assert "[SECRET]" in clean[505].text and clean[505].n_chars == len(clean[505].text) and clean[506].text.startswith("number")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()
