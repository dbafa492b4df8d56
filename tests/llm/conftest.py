import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, quality_score string, base_spans string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents at the edges: null, empty, blank, one word, copies, near copies, repeated rows, a long text, shared passages, columns with clashing names."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 40)
    texts = {
        1: None, 2: "", 3: " \n\t ", 4: "word", 5: "Two words", 6: base, 7: base, 8: base.upper(), 9: base.replace(" ", "\n"),
        10: base + " tail", 11: "head " + base[: len(base) // 2] + " x " + base[len(base) // 2 :], 12: words(rng, 60) + " " + passage + " " + words(rng, 30),
        13: passage, 14: words(rng, 8000), 15: words(rng, 200) + " " + passage, 16: "É ü ß 日本語 \u0001 end", 17: words(rng, 50), 18: base + " tail",
    }
    for k in range(20, 60):
        texts[k] = words(rng, 40 + k)
    out = [(i, t, "xx", "s", len(t or ""), "k", "q", "b") for i, t in texts.items()]
    return [*out, out[5], out[10]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
