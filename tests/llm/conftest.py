import random

import pytest

#: Columns that operators use inside, and some of any table, to clash with.
CLASHING = ["high", "low", "key", "label", "part", "size", "start", "row", "n", "center", "node", "chunk", "_id", "_size", "_skip", "name", "component_id", "piece", "digest", "refers_to", "last", "term", "place", "tie"]


def words(rng, n, vocabulary=400):
    return " ".join(f"{'abcdefghij'[rng.randrange(10)]}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source) with nulls, empty, blank and long texts, ties and repeated rows."""
    rng = random.Random(3)
    base = words(rng, 120)
    rows = [
        (None, "a row without id\nand a second line of it that is long enough", "s1"), (None, None, None), (1, None, "s1"), (2, "", "s2"), (3, " \t\n\n ", "s1"),
        (4, "one", None), (5, "two words", "s2"), (6, base, "s1"), (7, base, "s1"), (7, base, "s1"), (8, base.upper(), "s2"), (9, base + " more", "s3"),
        (10, "é 中文 𝒳   ñandú " * 30, "s3"), (11, words(rng, 30_000, 5000), "s1"), (12, "x" * 60_000, "s2"), (13, "line one is here and long\n" * 200, None),
        (14, "\n".join(words(rng, 12) for _ in range(40)), "s1"), (2**60, "the last document of all, with some words.", "s2"),
    ]
    return rows + [(100 + k, words(rng, rng.randrange(1, 90)), f"s{k % 4}") for k in range(60)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(*r, *(["z", None][k % 2 : k % 2 + 1] * len(CLASHING))) for k, r in enumerate(odd_rows)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra}").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def ids(rows):
    return sorted((r[0] for r in rows), key=lambda v: (v is not None, v or 0))
