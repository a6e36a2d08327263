import pytest

#: Null and empty texts, ties, repeated rows, odd characters, a long text and near copies.
_BASE = "The quick brown fox jumps over the lazy dog while twelve tired clerks file forms about rain and ships at sea"
_LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, _BASE), (5, _BASE), (5, _BASE), (6, _BASE + " now"), (7, "a" * 3000), (8, _LONG), (9, "Ünïcödé ŞİĞ 漢字 \U0001f600 it's 12 345!"),
    (10, "one two"), (None, "a row without an id"), (None, None), (11, "x\ny\nx\n\nx y z\n" * 3), (12, "Licensed under the Apache License, Version 2.0. See the MIT License."),
    (13, _BASE.replace("dog", "cat")), (14, "\r\x0b\x0c mixed space line\n" * 5),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows above with extra columns whose names clash with those that operators add."""
    rows = [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else "s", len(t or ""), "h", k, 0.5, "x", 7, "n") for k, (i, t) in enumerate(TEXTS)]
    names = "doc_id long, text string, lang string, source string, n_chars long, hash string, k int, score double, labels string, row long, n string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 15)] + [(4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
