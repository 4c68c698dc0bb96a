import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ta", "re", "ko", "mi", "su", "be", "lo", "ñu", "gri", "pla") for b in ("n", "sh", "tor", "el", "ing", "a", "ew", "ó", "lu", "st")]


def sentence(random_, n):
    return " ".join(random_.choice(WORDS) for _ in range(n))


def make_docs(seed=1, n=60):
    """Random texts with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    shared = sentence(r, 40)
    texts = [sentence(r, r.randrange(1, 120)) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = sentence(r, 10) + " " + shared + " " + sentence(r, 15)
    for i in range(3, n, 11):
        words = texts[i - 1].split()
        words[len(words) // 2] = "changed"
        texts[i] = " ".join(words)
    for i in range(5, n, 13):
        texts[i] = texts[i - 2]
    return [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]


def awkward_docs():
    """Nulls, empty and very long texts, ties, repeated rows and repeated ids."""
    r = random.Random(9)
    long = sentence(r, 30_000)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, long, "en", "a", len(long)), (5, long, "en", "b", len(long)), (6, "a", None, "a", 1),
        (7, "repeated row " * 20, "en", "a", 260), (7, "repeated row " * 20, "en", "a", 260), (8, "same id, one text " * 12, "en", "a", 1), (8, "same id, other text " * 12, "en", "a", 1),
        (None, "no id at all " * 15, "en", "a", 1), (None, None, None, None, None), (9, "x" * 5000, "en", "a", 5000), (10, "🙂é\x00\x85 <|endoftext|> " * 30, "en", "a", 9), (-3, "negative id", "en", "a", 11),
    ]


@pytest.fixture(scope="session")
def docs_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, DOCS).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_docs(), DOCS).repartition(2)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels_schema():
    return "doc_id long, quality int, toxic int"
