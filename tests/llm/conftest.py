import pytest

#: Extra columns with names that operators use inside.
EXTRA = "score double, class long, row long, label int, keys string, `group` int, length int, start long, rank int, n long"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
WORDS = ["the", "river", "stone", "walked", "over", "bridge", "morning", "light", "paper", "window", "green", "table", "seven", "garden", "winter", "music", "letter", "engine"]


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefgh") if r.random() < 0.3 else "") for _ in range(n)) + "."


def rows(texts):
    """Documents of (doc_id, text) with clashing extra columns; nulls in all of them for every third."""
    out = []
    for k, (i, t) in enumerate(texts):
        rest = (None,) * 13 if k % 3 == 0 else ("en", "src0", len(t or ""), 0.5, 7, 1, 1, "k", 2, 3, 4, 5, 6)
        out.append((i, t, *rest))
    return out


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda texts: spark.createDataFrame(rows(texts), DOCUMENTS)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, repeated, very long and oddly written texts."""
    long = prose(1, 60_000)
    base = prose(2, 300)
    near = base.replace("river", "rivers", 1)
    texts = [None, "", " \n\t ", "a", "Ünïcödé ßtraße 日本語  x", "don't 'll  \n\n it's", long, base, base, near, prose(3, 40), "<|endoftext|> end <|endoftext|>", "x" * 3000, "12345 67 8"]
    return [(10 + 3 * i, t) for i, t in enumerate(texts)] + [(31, base)]
